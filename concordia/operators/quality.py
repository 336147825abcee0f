"""Data-quality detectors, learned lexicons and robust statistics.

A detector is a function of tables that returns findings: detector, subject,
detail.  findings() joins them to one table with a fingerprint each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, med, mad: exact median and median absolute deviation, in two passes."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    off = df.select(*keys, value).join(med, list(keys))
    return off.groupBy(*keys, "med").agg(F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))


def robust_outliers(df: DataFrame, keys: Sequence[str], value: str, limit: float = 5.0) -> DataFrame:
    """Rows whose log value is `limit` robust deviations from their group's median; column z."""
    d = df.filter(F.col(value) > 0).withColumn("_ln", F.log(value))
    stats = median_mad(d, keys, "_ln").filter("mad > 0")
    z = (F.col("_ln") - F.col("med")) / (1.4826 * F.col("mad"))
    return d.join(stats, list(keys)).withColumn("z", z).filter(F.abs("z") >= limit).drop("_ln", "med", "mad")


def lift(docs: DataFrame, doc: str, group: str, tokens: str, least: int, factor: float) -> DataFrame:
    """group, token, k, df, lift: tokens at least `factor` times as frequent, by documents, in a group as overall."""
    sizes = docs.groupBy(group).agg(F.count("*").alias("ns"))
    total = sizes.agg(F.sum("ns").alias("n"))
    per = docs.select(group, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(group, "token").agg(F.count("*").alias("k"))
    df = per.groupBy("token").agg(F.sum("k").alias("df")).filter(F.col("df") >= least)
    d = per.join(df, "token").join(F.broadcast(total)).join(sizes, group)
    d = d.withColumn("lift", F.col("k") * F.col("n") / (F.col("df") * F.col("ns")))
    return d.filter(F.col("k") * F.col("n") >= factor * F.col("df") * F.col("ns")).select(group, "token", "k", "df", "lift")


def finding(df: DataFrame, detector: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(detector).alias("detector"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def findings(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All detectors' findings, once per detector and subject (the least detail), with a fingerprint."""
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no detectors")
    once = out.groupBy("detector", "subject").agg(F.min("detail").alias("detail"))
    return once.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", "detector", "subject"), 256))


# -- text hygiene: a rule is a predicate of one text -----------------------------

TEXT_RULES: dict[str, str] = {
    "invisible_characters": r"[​-‏⁠﻿­\x00-\x08\x0B\x0C\x0E-\x1F]",
    "irregular_spaces": r"^[ \t]|[ \t]$|[ \t]{2,}|[ \t]+[,.;:!?]",
    "broken_encoding": r"Ã[-¿]|â€|Â[ -¿]",
    "html_entities": r"&(?:[a-zA-Z]{2,8}|#[0-9]{2,5});",
    "dangling_signs": r"[-–,;:/&+]\s*$",
    "address_in_name": r"(?i)https?://|www\.[a-z0-9-]+\.",
    "duration_in_title": r"(?:^|[\s(\[])[0-9]{1,2}:[0-5][0-9](?:$|[\s)\]])",
}


def unclosed(c: Column) -> Column:
    """Brackets that open and do not close, or the other way round."""
    n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return (n("(") != n(")")) | (n("[") != n("]")) | (n("{") != n("}"))


def sustained_capitals(c: Column, least: int = 8) -> Column:
    letters = F.regexp_replace(c, r"\P{L}+", "")
    return (F.length(letters) >= least) & (F.upper(letters) == letters) & (F.lower(letters) != letters)


def text_findings(df: DataFrame, subject: str, text: str, rules: Mapping[str, str] = TEXT_RULES) -> DataFrame:
    """One pass over the texts: the rules that hold are exploded."""
    marks = [F.when(F.col(text).rlike(r), F.lit(k)) for k, r in rules.items()]
    marks += [F.when(unclosed(F.col(text)), F.lit("unclosed_signs")), F.when(sustained_capitals(F.col(text)), F.lit("sustained_capitals"))]
    d = df.select(subject, F.explode(F.array_compact(F.array(*marks))).alias("detector"))
    return d.select("detector", F.col(subject).cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))


# -- sequences and relations ------------------------------------------------------


def numbering_gaps(df: DataFrame, keys: Sequence[str], number: str, most: int = 99) -> DataFrame:
    """keys, missing: numbers from 1 to the largest that a group lacks."""
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_set(number)).alias("_have"), F.max(number).alias("_max"))
    d = d.filter(F.col("_max").between(1, most))
    missing = F.array_except(F.sequence(F.lit(1), F.col("_max").cast("int")), F.transform("_have", lambda x: x.cast("int")))
    return d.select(*keys, missing.alias("missing")).filter(F.size("missing") > 0)


def equal_key_pairs(df: DataFrame, key: Sequence[str], ident: str, handled: DataFrame | None = None) -> DataFrame:
    """a, b: each row of a key group with the group's first one, without pairs settled before.

    Pairs with the group's representative say as much as all pairs, and a group
    of n rows gives n - 1 of them.
    """
    first = F.min(ident).over(Window.partitionBy(*key))
    d = df.withColumn("a", first).filter(F.col(ident) > F.col("a")).select("a", F.col(ident).alias("b"), *key)
    if handled is not None:
        seen = handled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        d = d.join(seen, ["a", "b"], "left_anti")
    return d


def duplicate_groups(df: DataFrame, key: Sequence[str], ident: str, refs: str, guards: Sequence[str] = ()) -> DataFrame:
    """key, keep, ids: groups of equal key whose guard columns do not contradict each other.

    keep is the row with the most references, then the smallest id.
    """
    aggs = [F.countDistinct(g).alias(f"_g{i}") for i, g in enumerate(guards)]
    best = F.max_by(ident, F.struct(F.col(refs), -F.col(ident))).alias("keep")
    d = df.groupBy(*key).agg(best, F.array_sort(F.collect_list(ident)).alias("ids"), *aggs).filter(F.size("ids") > 1)
    for i in range(len(guards)):
        d = d.filter(F.col(f"_g{i}") <= 1)
    return d.select(*key, "keep", "ids")


def without_links(df: DataFrame, ident: str, *links: DataFrame) -> DataFrame:
    """Rows that no link table mentions; links: one column, the id."""
    for x in links:
        c = x.columns[0]
        df = df.join(x.select(F.col(c).alias(ident)), ident, "left_anti")
    return df


def redirect_chains(redirects: DataFrame) -> DataFrame:
    """source, target, next: redirects to rows that redirect again; redirects: source, target."""
    nxt = redirects.select(F.col("source").alias("target"), F.col("target").alias("next"))
    return redirects.join(nxt, "target").select("source", "target", "next")


# -- anomalies ---------------------------------------------------------------------


def field_anomalies(df: DataFrame, ident: str, field: str, least: int = 50, z_limit: float = 8.0) -> DataFrame:
    """ident, reason: the first of rare_sign, foreign_script, length, letters that holds against the field's own profile."""
    d = df.select(F.col(ident), F.col(field).alias("v")).filter("v is not null and v <> ''")
    n = F.length("v")
    letters = F.length(F.regexp_replace("v", r"\P{L}+", "")) / n
    d = d.withColumn("len", n.cast("double")).withColumn("ratio", letters)
    d = d.withColumn("foreign", F.col("v").rlike(r"[\p{L}&&[^\p{IsLatin}]]"))
    signs = d.select(ident, F.explode(F.array_distinct(F.regexp_extract_all("v", F.lit(r"([\p{P}\p{S}])"), F.lit(1)))).alias("sign"))
    docs = d.agg(
        F.count("*").alias("n"), F.percentile("len", F.lit(0.5)).alias("med"), F.percentile("ratio", F.lit(0.5)).alias("mratio"), F.avg(F.col("foreign").cast("double")).alias("fshare")
    )
    mad = d.join(F.broadcast(docs.select("med"))).agg(F.percentile(F.abs(F.col("len") - F.col("med")), F.lit(0.5)).alias("mad"))
    profile = F.broadcast(docs.join(mad))
    freq = signs.groupBy("sign").agg(F.count("*").alias("df")).join(F.broadcast(docs.select("n")))
    rare = freq.filter(F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.0005))).select("sign")
    odd = signs.join(rare, "sign").select(ident).distinct().withColumn("odd", F.lit(True))
    d = d.join(odd, ident, "left").join(profile).filter(F.col("n") >= least)
    z = F.when(F.col("mad") > 0, (F.col("len") - F.col("med")) / (1.4826 * F.col("mad")))
    reason = (
        F.when(F.col("odd"), "rare_sign")
        .when(F.col("foreign") & (F.col("fshare") < 0.01), "foreign_script")
        .when((z > z_limit) & (F.col("len") > 2 * F.col("med")), "length")
        .when((F.col("ratio") < 0.35) & (F.col("mratio") >= 0.8), "letters")
    )
    return d.select(ident, reason.alias("reason")).filter("reason is not null")
