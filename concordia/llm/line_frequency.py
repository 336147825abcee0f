"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits alike, blanks collapsed) and hashed;
for every host the distinct documents of a line are counted, copies of one text
once.  Lines above the host's limit are removed, and a document that keeps too
few of its words is depleted and rejected.  The base figures of a text (words,
symbols, duplicate lines, repeated five-word windows) are row functions.

Cases: null text has no words and fails the base rules; a null host is a host
of its own; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows: hashes by position.

    Sorting puts equal hashes side by side, so each window looks at its two
    neighbours only.
    """

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("t"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["t"] + F.least(F.lit(WINDOW), p - a["last"])).alias("t"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["t"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A one-element transform gives the sorted array a name, so that it is built once.
    counted = F.element_at(F.transform(F.array(pairs), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(counted)


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, source, _h (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines (hash, words)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"))
    d = d.withColumn("_w", F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get("_w", i + j)
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))
    d = d.withColumn("n_words", F.size("_w"))
    d = d.withColumn("_win", F.when(F.col("n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    clean = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.transform(
        F.filter(F.split(clean, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.size(F.split(F.trim(x), " ")).alias("w")),
    )
    return d.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("_h"),
        F.col("n_words").cast("long"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_win")).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
    )


def line_quality(docs: DataFrame, share: float = 0.05, least: int = 20, keep_percent: int = 30) -> DataFrame:
    """The base figures, base_failed, words_removed and kept, one row per row of docs.

    A line is above its host's limit if more than max(least, share * documents)
    of the host's distinct texts have it; a document is depleted if less than
    keep_percent of its words are left.
    """
    rows = written(base_figures(docs).withColumn("_rid", F.monotonically_increasing_id()), "op7-figures")
    lines = rows.select("source", "_h", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line"))
    texts = lines.groupBy("source", "line", "_h").agg(F.lit(1).alias("one"))
    counts = texts.groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    hosts = rows.groupBy("source", "_h").agg(F.lit(1).alias("one")).groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("docs"))
    over = counts.join(hosts, F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("n") > share * F.col("docs"))
    over = written(over.select(F.col("source").alias("_os"), F.col("line").alias("_ol")), "op7-over")
    own = rows.select("_rid", "source", F.inline("lines"))
    gone = own.join(over, F.col("source").eqNullSafe(F.col("_os")) & (F.col("h") == F.col("_ol")), "left_semi")
    gone = gone.groupBy("_rid").agg(F.sum("w").alias("_gone"))
    d = rows.join(gone, "_rid", "left").withColumn("words_removed", F.coalesce("_gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("words_removed")) >= keep_percent * F.col("n_words")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & left).alias("kept"), "words_removed",
    )
