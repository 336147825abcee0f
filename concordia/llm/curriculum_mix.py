"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time 0..1.  Its integral,
scaled to the source's target, is the source's cumulative token demand; a
document starts at the demand that the documents before it (in a fixed hash
order) have met, and inverting the demand gives its training position.  All
documents are range-sorted by position.

Cases: null text has size 0 and is never taken; a null source is a source of
its own and comes last; repeated rows are rows of their own; an empty table
gives an empty result; sources whose sizes are all 0 have target 0; very long
texts are taken up to three times whole or in part like any other; documents of
equal hash follow one another by doc_id and size; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cleared, running_total, without, written

#: Relative intensity at times 0, 1/2 and 1 for the sources of each weight class.
SCHEDULES: tuple[tuple[float, ...], ...] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, class, target: shares of the total size by weight, filled like water up to cap x size.

    sizes: source, source_size, one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    d = sizes.withColumn("class", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    d = d.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("class") + 1))
    d = d.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("r", F.col("limit") / F.col("w"))
    # The sources that reach their limit are those with the least limit per weight.
    by = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    open_ = F.col("level") <= F.col("r")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("r"))).over(whole)
    return d.withColumn("fill", level).select(
        "source", "source_size", "class", F.least(F.col("limit"), F.coalesce(F.col("fill") * F.col("w"), F.col("limit"))).alias("target")
    )


def invert_demand(u: Column, knots: Sequence[float]) -> Column:
    """Time at which a share u of a source's demand is met; knots: intensity at equal steps, linear between them."""
    n = len(knots) - 1
    areas = [(a + b) / (2 * n) for a, b in zip(knots, knots[1:])]
    total = sum(areas)
    out, done = F.lit(1.0), total
    for i in range(n - 1, -1, -1):
        done -= areas[i]
        a, b = knots[i], knots[i + 1]
        y = F.greatest(u * total - F.lit(done), F.lit(0.0)) * n  # area within the piece, in units of its length
        if a == b:
            t = y / a
        else:
            t = (F.sqrt(F.lit(a * a) + 2 * (b - a) * y) - a) / (b - a)
        t = (F.lit(float(i)) + F.least(t, F.lit(1.0))) / n
        out = t if i == n - 1 else F.when(u * total < F.lit(done + areas[i]), t).otherwise(out)
    return out


def curriculum(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    buckets: int = 1024,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, position (of the first copy), sorted by position.

    A source is walked through in hash order, as often as its target holds its
    size; the document at which the last round ends is taken in part.
    """
    narrow = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("_h"),
        F.xxhash64("text").alias("_t"),
    )
    narrow = written(narrow, "op4-sizes")
    targets = written(
        source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "op4-targets"
    )
    d = running_total(narrow, ["source"], "_h", ["doc_id", "size"], F.col("size"), "_at", buckets)
    t = targets.withColumnRenamed("source", "_s")
    d = d.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("_rounds") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    d = d.withColumn("_rounds", rounds).withColumn("_part", part)
    d = d.withColumn("taken", (F.col("_rounds") * F.col("size") + F.col("_part")).cast("long"))
    d = d.withColumn("copies", (F.col("_rounds") + (2 * F.col("_part") >= F.col("size")).cast("int")).cast("int"))
    d = d.withColumn("copies", F.when(F.col("taken") > 0, F.col("copies")).otherwise(0))
    pos = position(F.col("_at"), schedules)
    return d.withColumn("position", F.when(F.col("taken") > 0, pos)).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "class", F.col("_at").alias("start"), "_h", "_t"
    )  # range-sorted by whoever writes it: sort("position")


def position(start: Column, schedules: Sequence[Sequence[float]] = SCHEDULES, prefix: str = "") -> Column:
    """Training position of the demand at `start` words into the source."""
    u = start / F.col(f"{prefix}target")
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col(f"{prefix}class") == i, invert_demand(u, knots)).otherwise(out)
    return out


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for every copy, range-sorted by training position.

    Rows that are equal in doc_id, source and text each have places of their own.
    """
    key = [F.col("doc_id"), F.col("source"), F.xxhash64("text")]
    with cleared() as keep:
        got = written(curriculum(docs).filter("copies > 0"), "op4-mix")
        cell = ["doc_id", "source", "_t"]
        twice = keep(written(got.groupBy(*cell).agg(F.count("*").alias("c")).filter("c > 1").select(*cell), "op4-twice"))
        none = keep(written(twice.limit(0), "op4-none"))
        at = position(F.col("start") + F.col("copy") * F.col("source_size"))
        took = got.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        took = keep(written(took.select(*[F.col(c).alias(f"{c}_of") for c in cell], "_h", at.alias("at")), "op4-places"))
    one = without(docs, key, none, twice)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = one.select(*[k.alias(c) for k, c in zip(key, cell, strict=True)], row)
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in cell]
    return d.join(took, on).sort("at", "_h").select("row.*")
