"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bin_completion,
    bootstrapped_pii,
    bounded_ring,
    curriculum_mix,
    fingerprint_dedup,
    language_fusion,
    line_frequency,
    shingle_join,
    sparse_suffixes,
    token_attribution,
)
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return token_attribution.section_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_fusion.of_documents(table(spark, sf_dir, "documents"))
    return language_fusion.classify(docs).withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op2 where markup and addresses speak: web pages."""
    pages = language_fusion.of_pages(table(spark, sf_dir, "pages"))
    return language_fusion.classify(pages).withColumnRenamed("id", "page_id")


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrapped_pii.personal_data(table(spark, sf_dir, "documents"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = curriculum_mix.curriculum(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").sort("position", "doc_id")


def op5_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_quality(table(spark, sf_dir, "documents"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(table(spark, sf_dir, "documents"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_ring.shard_rows(table(spark, sf_dir, "documents"), shards=24)


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_attribution,
        op2_language_fusion,
        op3_bootstrapped_pii,
        op4_curriculum_mix,
        op5_fingerprint_dedup,
        op6_sparse_suffixes,
        op7_line_frequency,
        op8_shingle_join,
        op9_bounded_ring,
        op10_bin_completion,
        language_of_pages,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_fingerprint_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op7_line_frequency": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
        l AS (SELECT doc_id, source, t, l FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM l GROUP BY 1),
        k AS (SELECT doc_id, source, t, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS k FROM l),
        host AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY 1),
        top AS (SELECT k.source, k, count(DISTINCT t) AS n FROM k GROUP BY 1, 2),
        gone AS (SELECT doc_id, sum(len(string_split(k.k, ' '))) AS words_removed FROM k JOIN top ON k.source IS NOT DISTINCT FROM top.source AND k.k = top.k
                 JOIN host ON k.source IS NOT DISTINCT FROM host.source WHERE n > 20 AND n > 0.05 * docs GROUP BY 1),
        f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed
              FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - words_removed) >= 30 * n_words AS kept FROM f
    """,
    "op8_shingle_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) m ON m.a = w.doc_id
    """,
}
