"""Tiered search over exploded keys, miss logs and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def build_index(entities: DataFrame) -> DataFrame:
    """kind, entity_id, name, weight, key: one row per searchable key; entities: kind, entity_id, name, aliases, weight."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: T.secondary_key(x)))
    d = entities.select("kind", "entity_id", "name", "weight", F.explode(names).alias("key"))
    return d.filter("key <> ''")


def tier(key: Column, needle: Column) -> Column:
    """0 equal, 1 starts with, 2 a word starts with, 3 contains (three letters or more), else null."""
    return (
        F.when(key == needle, 0)
        .when(F.startswith(key, needle), 1)
        .when(F.contains(key, F.concat(F.lit(" "), needle)), 2)
        .when((F.length(needle) >= 3) & F.contains(key, needle), 3)
    )


def search(index: DataFrame, q: str, limit: int = 10, cap: int = 200) -> DataFrame:
    """kind, entity_id, name, weight, tier, place, total (up to cap): the best `limit` per kind."""
    needle = T.secondary_key(F.lit(q))
    d = index.withColumn("tier", tier(F.col("key"), needle)).filter("tier is not null")
    d = d.groupBy("kind", "entity_id", "name", "weight").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("kind").orderBy("tier", F.desc("weight"), "name", "entity_id")
    total = F.least(F.count("*").over(Window.partitionBy("kind")), F.lit(cap))
    return d.withColumn("place", F.row_number().over(w)).withColumn("total", total).filter(F.col("place") <= limit)


def search_many(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """qid, entity_id, tier, place of many queries (qid, q) at once.

    Prefix tiers are equi-joins on word starts of the needle's length, so
    queries meet only keys that begin a word like them.
    """
    q = queries.select("qid", T.secondary_key(F.col("q")).alias("needle")).withColumn("_n", F.length("needle")).filter("_n > 0")
    lengths = q.select("_n").distinct()
    words = index.withColumn("_w", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", " "))), lambda i: F.array_join(F.slice(F.split("key", " "), i, 1000), " "))))
    starts = words.join(F.broadcast(lengths), F.length("_w") >= F.col("_n")).withColumn("_s", F.expr("substring(_w, 1, _n)"))
    d = starts.join(q.select("qid", "needle"), F.col("_s") == F.col("needle"))
    t = F.when(F.col("key") == F.col("needle"), 0).when(F.startswith("key", "needle"), 1).otherwise(2)
    d = d.groupBy("qid", "entity_id", "weight", "name").agg(F.min(t).alias("tier"))
    w = Window.partitionBy("qid").orderBy("tier", F.desc("weight"), "name", "entity_id")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("qid", "entity_id", "tier", "place")


def misses(log: DataFrame) -> DataFrame:
    """key, n, first_seen, last_seen of queries without results; log: q, results, ts."""
    d = log.filter("results = 0").withColumn("key", T.secondary_key(F.col("q")))
    return d.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def label_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (micro) and exact share of label sets as arrays; null where a denominator is 0."""
    both = F.size(F.array_intersect(gold, predicted))
    d = df.agg(
        F.sum(both).alias("tp"), F.sum(F.size(predicted) - both).alias("fp"), F.sum(F.size(gold) - both).alias("fn"),
        F.avg((F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(predicted))).cast("double")).alias("exact"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "exact")


def mutual(relations: DataFrame) -> DataFrame:
    """relations (a, b) with mutual: whether b names a as well."""
    back = relations.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("_m", F.lit(True))
    return relations.join(back, ["a", "b"], "left").withColumn("mutual", F.coalesce("_m", F.lit(False))).drop("_m")
