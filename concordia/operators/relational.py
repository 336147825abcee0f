"""Relational idioms that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key, with their rank; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def divide(df: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Keys that have every item of `wanted` (relational division)."""
    need = wanted.select(item).distinct()
    have = df.join(need, item, "left_semi").groupBy(key).agg(F.countDistinct(item).alias("_n"))
    return have.join(need.agg(F.count("*").alias("_all")), F.col("_n") == F.col("_all")).select(key)


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges in both directions, so that an OR join becomes an equi-join."""
    others = [c for c in edges.columns if c not in (a, b)]
    back = edges.select(F.col(b).alias(a), F.col(a).alias(b), *others)
    return edges.select(a, b, *others).unionByName(back)


def full_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "full")


def keyed_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and change: added, removed, changed or same, comparing nulls as values."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return o.join(n, list(keys), "full").withColumn("change", change)


def insert_missing(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with the rows whose key it lacks, one per key (ON CONFLICT DO NOTHING)."""
    fresh = rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with rows put in place of those of equal key (ON CONFLICT DO UPDATE)."""
    return existing.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*existing.columns))


def rotated(df: DataFrame, day: int, step: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Place of every row in a circle that moves on by `step` a day: column `place` from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*keys))
    shift = F.pmod(F.lit(day * step), n)
    return df.withColumn("place", F.pmod(F.row_number().over(w) - 1 - shift, n))


def daily_order(seed: str, *cols: Column) -> Column:
    """A shuffle that a day fixes: the MD5 of the columns and the day."""
    return F.md5(F.concat(*[c.cast("string") for c in cols], F.lit(seed)))


def natural_keys(c: Column) -> tuple[Column, Column]:
    """Text before a trailing number, and the number, for natural order."""
    return F.regexp_replace(c, r"\s*[0-9]+$", ""), F.regexp_extract(c, r"([0-9]+)$", 1).cast("long")


def largest_gap(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the widest gap between neighbours of a sorted sequence: gap, below, above (earliest of equals)."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct().withColumn("above", F.lead(value).over(w))
    d = d.filter("above is not null").withColumn("gap", F.col("above") - F.col(value))
    return latest_by(d, keys, [F.desc("gap"), F.col(value)]).withColumnRenamed(value, "below")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key joined into one; one without a start touches none, one without an end reaches nowhere."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    d = d.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_isle")


def follow(pointers: DataFrame, source: str, target: str, most: int = 16) -> DataFrame:
    """Redirects with their final target, by pointer doubling: `most` doublings follow chains of 2^most links."""
    d = pointers.select(F.col(source), F.col(target))
    for _ in range(most):
        nxt = d.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
        step = d.join(nxt, F.col(target) == F.col("_s"), "left")
        done = step.filter("_s is not null and _t <> " + target).limit(1)
        d = step.select(source, F.coalesce("_t", target).alias(target))
        if not done.head(1):
            break
        d = d.checkpoint() if d.sparkSession.sparkContext.getCheckpointDir() else d
    return d
