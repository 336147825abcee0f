"""Language identification by Bayesian fusion of independent evidence.

The posterior of a language is proportional to
    P(text | language) ^ damping * P(declared | language) * P(suffix | language) * P(language | host)
- text: naive Bayes on hashed byte trigrams, fitted on a bounded sample of the
  documents of every declared language (`sample` rows of each, by hash);
- declared: the language of the markup or of the metadata, trusted to a degree
  that is counted, over all documents, from its agreement with the text;
- suffix: the address suffix, as counts by (suffix, language) over all documents;
- host: counts over all documents, smoothed towards the host's suffix, and that
  towards the whole corpus.

Against the languages stands one more hypothesis, that the text is in none of
them: its letters come as often as in the nearest language, but without the
order of one (`TextModel.other`).  Where it wins, the document is rejected.

Counts are grouped aggregations over all rows; only tables with one row per
(language, trigram bucket) or (language, language) reach the driver, for `most`
languages.  What hosts and suffixes say stays a table and is joined.

Cases: null or empty text, or text without letters, has no text evidence and is
rejected; null declared language, suffix or host say nothing; every declared
language is modelled, unless none of its texts has letters or `most` others have
more documents (what it declares then says nothing); of languages of equal
posterior the first in code point order wins; repeated rows get a row each; very
long texts are read whole; other columns may have any names; an empty table, or
one without any declared language, gives null languages and rejects all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, texts, written

BITS = 16
OTHER = 0.02  # prior of a text in none of the languages


def declared_in_markup(html: Column) -> Column:
    """Primary tag of <html lang=...>, null if none."""
    got = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.nullif(F.lower(got), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def letters(text: bytes) -> np.ndarray:
    """Bytes of the lower-cased text; digits and ASCII marks count as one blank."""
    b = np.frombuffer(text.lower(), dtype=np.uint8)
    b = np.where(((b >= 97) & (b <= 122)) | (b >= 128), b, 32).astype(np.uint32)
    return b[(b != 32) | (np.concatenate([[32], b[:-1]]) != 32)] if len(b) else b


def buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of letters()."""
    b = letters(text)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    return buckets(b[:-2], b[1:-1], b[2:])


def unordered(letter_counts: np.ndarray) -> np.ndarray:
    """P(bucket) of letters that come by their frequency alone; a tenth goes to all buckets alike."""
    abc = np.array([32, *range(97, 123), *range(128, 256)], dtype=np.uint32)
    p = letter_counts[abc] / max(1, letter_counts[abc].sum())
    a, b, c = np.meshgrid(abc, abc, abc, indexing="ij")
    every = np.bincount(buckets(a, b, c).ravel(), (p[:, None, None] * p[:, None] * p).ravel(), 1 << BITS)
    return 0.9 * every + 0.1 / (1 << BITS)


class TextModel:
    """log P(trigram | language), smoothed towards the letters of the language without their order (`base`).

    A trigram that a language has not shown is thus less likely in it than in no
    language, and one of which little text is known is never far from its base.
    """

    def __init__(self, languages: Sequence[str], counts: np.ndarray, letter_counts: np.ndarray, alpha: float = 0.5):
        self.languages = list(languages)
        none, mass = np.zeros((0, 1 << BITS)), alpha * (1 << BITS)
        base = np.stack([unordered(c) for c in letter_counts]) if len(languages) else none
        smooth = (counts + mass * base) / (counts.sum(axis=1, keepdims=True) + mass) if len(languages) else none
        self.logp, self.base = np.log(smooth).astype(np.float32), np.log(base).astype(np.float32)

    def other(self, text: bytes) -> float:
        """Log likelihood of the text in none of the languages."""
        return float(self.base[:, trigrams(text)].sum(axis=1, dtype=np.float64).max())

    def score(self, text: bytes) -> np.ndarray | None:
        """Log likelihood per language, None without evidence."""
        t = trigrams(text)
        return self.logp[:, t].sum(axis=1, dtype=np.float64) if len(t) else None


def fit_text(docs: DataFrame, sample: int = 4000, least: int = 1, most: int = 256) -> TextModel:
    """docs: id, text, declared.  Fits on about `sample` rows of each declared language, those whose hash falls under that share.

    No row is moved or sorted for it, and a language with `sample` rows or fewer gives all of them, so none is
    lost however small its share; those with fewer than `least` rows, or with fewer than `most` others have, are left out.
    """
    rows = docs.filter(F.col("declared").isNotNull() & F.col("text").isNotNull())
    sizes, span = rows.groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(most), 1 << 40
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")) * F.lit(float(span))
    sizes = sizes.select(F.col("declared").alias("_of"), share.alias("_share"))
    chosen = rows.join(F.broadcast(sizes), F.col("declared") == F.col("_of")).filter(F.pmod(F.xxhash64("id", "text"), F.lit(span)) < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (1 << BITS) + 256  # trigram buckets, then letters
        total: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            for lang, x in zip(b.column("declared").to_pylist(), texts(b), strict=True):
                c = total.setdefault(lang, np.zeros(width, dtype=np.int64))
                c[: 1 << BITS] += np.bincount(trigrams(x), minlength=1 << BITS)
                c[1 << BITS :] += np.bincount(letters(x).astype(np.int64), minlength=256)
                n[lang] = n.get(lang, 0) + 1
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], n[lang]))], ["declared", "at", "n"]
            )

    got = chosen.select("declared", "text").mapInArrow(count, "declared string, at long, n long").groupBy("declared", "at").agg(F.sum("n").alias("n")).toPandas()
    seen = got[got["at"] < 0].set_index("declared")["n"]
    lettered = set(got[(got["at"] >= 0) & (got["at"] < 1 << BITS)]["declared"])
    languages = sorted(x for x, n in seen.items() if n >= min(least, max(1, seen.max())) and x in lettered)
    counts = np.zeros((len(languages), (1 << BITS) + 256))
    for i, lang in enumerate(languages):
        part = got[(got["declared"] == lang) & (got["at"] >= 0)]
        counts[i, part["at"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=np.float64)
    return TextModel(languages, counts[:, : 1 << BITS], counts[:, 1 << BITS :])


def text_labels(docs: DataFrame, model: TextModel) -> DataFrame:
    """host, suffix, declared, said (most likely by text alone, null without evidence or in no language), n: counts per task, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            said = []
            for x in texts(b):
                s = model.score(x)
                said.append(None if s is None or not len(s) or s.max() < model.other(x) else model.languages[int(s.argmax())])
            seen = Counter(zip(*[b.column(c).to_pylist() for c in ("host", "suffix", "declared")], said, strict=True))
            cols = [*zip(*seen, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in cols], pa.array(list(seen.values()), pa.int64())], ["host", "suffix", "declared", "said", "n"]
            )

    return docs.select("host", "suffix", "declared", "text").mapInArrow(run, "host string, suffix string, declared string, said string, n long")


def table_of(df: DataFrame, row: str, languages: Sequence[str]) -> dict[str, np.ndarray]:
    """Counts by (row, said) for rows that are languages themselves, as arrays."""
    got = df.filter(F.col(row).isin(list(languages)) & F.col("said").isNotNull()).groupBy(row, "said").agg(F.sum("n").alias("n")).toPandas()
    out: dict[str, np.ndarray] = {}
    for r in got.itertuples(index=False):
        out.setdefault(r[0], np.zeros(len(languages)))[languages.index(r[1])] = r[2]
    return out


def places(counts: DataFrame, languages: Sequence[str], strength: float = 10.0) -> DataFrame:
    """_host, _suffix, prior (array by language), says (the suffix's log likelihood by language, and in no language at last; null for a null suffix).

    Host counts are smoothed towards the suffix's, those towards the corpus'.
    """
    n = F.col("n").cast("double")
    cols = [F.coalesce(F.sum(F.when(F.col("said") == x, n)), F.lit(0.0)) for x in languages]
    by = lambda keys, name: counts.groupBy(*keys).agg(F.array(*cols).alias(name))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smooth(own: str, above: Column) -> Column:
        return F.zip_with(own, above, lambda x, p: (x + F.lit(strength) * p) / (total(own) + F.lit(strength)))

    flat = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    world = by([], "w").select(smooth("w", flat).alias("w"))
    known = counts.filter("suffix is not null").agg(F.array(*cols).alias("all"), F.count_distinct("suffix").alias("kinds"))
    share = lambda c, of: F.log((c + 1.0) / (of + F.col("kinds") + 1.0))
    says = F.concat(F.zip_with("s0", "all", share), F.array(share(total("s0"), total("all"))))
    suffix = by(["suffix"], "s0").crossJoin(F.broadcast(world)).crossJoin(F.broadcast(known))
    suffix = suffix.select(F.col("suffix").alias("_sx"), smooth("s0", F.col("w")).alias("s"), F.when(F.col("suffix").isNotNull(), says).alias("says"))
    host = by(["host", "suffix"], "h").join(suffix, F.col("suffix").eqNullSafe(F.col("_sx")))
    return host.select(F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), smooth("h", F.col("s")).alias("prior"), "says")


class Fusion:
    """The text model and how far a declared language is to be trusted: tables of bounded size."""

    def __init__(self, model: TextModel, agree: dict[str, np.ndarray], damping: float):
        k = max(1, len(model.languages))
        self.model, self.damping = model, damping
        self.languages = model.languages
        total = sum(agree.values(), np.zeros(len(self.languages)))
        self.agree = {d: np.log((c + 0.5) / (total + 0.5 * (len(agree) + 1))) for d, c in agree.items()}
        # In no language: what is declared says as much as over all texts.
        self.any_agree = {d: np.log((c.sum() + 0.5) / (total.sum() + 0.5 * (len(agree) + 1))) for d, c in agree.items()}
        self.flat = np.full(len(self.languages), 1.0 / k)

    def posterior(self, text: bytes, declared: str | None, prior: Sequence[float] | None, says: Sequence[float] | None) -> tuple[np.ndarray | None, int | None]:
        """Posterior by language and the language of the text alone; the posteriors leave the rest to no language."""
        s = self.model.score(text) if self.languages else None
        if s is None:
            return None, None
        said = int(s.argmax())
        suffix = np.asarray(says) if says is not None else np.zeros(len(s) + 1)
        z = s * self.damping + self.agree.get(declared, 0.0) + suffix[:-1] + np.log(np.asarray(prior) if prior is not None else self.flat)
        none = self.model.other(text) * self.damping + self.any_agree.get(declared, 0.0) + suffix[-1] + np.log(OTHER)
        top = max(z.max(), none)
        z = np.exp(z - top)
        return z / (z.sum() + np.exp(none - top)), said


def fit(docs: DataFrame, sample: int = 4000, damping: float = 0.2) -> tuple[Fusion, DataFrame | None]:
    """docs: id, text, declared, suffix, host (host and suffix may be null)."""
    model = fit_text(docs, sample)
    if not model.languages:
        return Fusion(model, {}, damping), None
    counts = text_labels(docs, model).groupBy("host", "suffix", "declared", "said").agg(F.sum("n").alias("n"))
    counts = written(counts, "op2-counts")
    fused = Fusion(model, table_of(counts, "declared", model.languages), damping)
    out = written(places(counts, model.languages), "op2-places")
    drop_written(counts)
    return fused, out


def evidence(docs: DataFrame, declared: Column, host: Column, suffix: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns that fit() reads, beside all of docs as the struct `_row`."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.nullif(F.lower(declared), F.lit("")).alias("declared"),
        F.lower(host).alias("host"),
        F.lower(suffix).alias("suffix"),
    )


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = 4000, keep_rows: bool = False) -> DataFrame:
    """docs as evidence() gives them -> id, language, posterior, text_language, kept (or, with keep_rows, _row of what is kept)."""
    fused, known = fit(docs.select("id", "text", "declared", "host", "suffix"), sample)
    if known is None:
        d = docs.withColumn("prior", F.lit(None).cast("array<double>")).withColumn("says", F.lit(None).cast("array<double>"))
    else:  # a host may hold a third of all rows: rows are dealt out by host and salt where the table is too large to send around
        salts = 16
        p = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        d = docs.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)))
        on = F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")) & (F.col("_s") == F.col("_salt"))
        d = d.join(p, on, "left")

    def judge(b: pa.RecordBatch) -> tuple[list, list, list, list]:
        language, post, said, kept = [], [], [], []
        for x, *more in zip(texts(b), *[b.column(c).to_pylist() for c in ("declared", "prior", "says")], strict=True):
            p, s = fused.posterior(x, *more)
            i = None if p is None else int(p.argmax())
            language.append(None if p is None else fused.languages[i])
            post.append(None if p is None else float(p[i]))
            said.append(None if s is None else fused.languages[s])
            kept.append(p is not None and p[i] >= threshold)
        return language, post, said, kept

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("_row").filter(pa.array(judge(b)[3]))], ["_row"])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lang, post, said, kept = judge(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(lang, pa.string()), pa.array(post, pa.float64()), pa.array(said, pa.string()), pa.array(kept, pa.bool_())],
                    ["id", "language", "posterior", "text_language", "kept"],
                )

    if keep_rows:
        d = d.select("_row", "text", "declared", "prior", "says")
        return d.mapInArrow(rows, docs.select("_row").schema).select("_row.*")
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, language string, posterior double, text_language string, kept boolean"
    return d.select("id", "text", "declared", "prior", "says").mapInArrow(verdicts, out)


def of_documents(docs: DataFrame) -> DataFrame:
    """documents: `lang` is declared, `source` is the host; there is no address."""
    none = F.lit(None).cast("string")
    return evidence(docs, F.col("lang"), F.col("source"), none)


def of_pages(pages: DataFrame) -> DataFrame:
    """pages: the markup declares, the url has host and suffix; scripts, styles and tags are no text."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = host_of(F.col("url"))
    return evidence(pages.withColumn("_plain", plain), declared_in_markup(F.col("html")), host, suffix_of(host), "page_id", "_plain")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is clear, with all columns."""
    return classify(of_documents(docs), keep_rows=True).select(*docs.columns)
