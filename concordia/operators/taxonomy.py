"""A three-level taxonomy: lineage, facets, rules over several sources, derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lineage(nodes: DataFrame) -> DataFrame:
    """node, ancestor, depth of every node and itself; nodes: id, parent; three levels, by two self-joins."""
    n = nodes.select("id", "parent")
    up = n.select(F.col("id").alias("_p"), F.col("parent").alias("_pp"))
    one = n.join(up, F.col("parent") == F.col("_p"), "left")
    chain = F.filter(F.array(F.col("id"), F.col("parent"), F.col("_pp")), lambda x: x.isNotNull())
    return one.select(F.col("id").alias("node"), F.posexplode(chain).alias("depth", "ancestor")).select("node", "ancestor", "depth")


def with_descendants(assigned: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities assigned to a wanted node or to any node below it; assigned: entity, node; wanted: node."""
    down = lines.join(wanted.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()
    return assigned.join(down, "node", "left_semi").select("entity").distinct()


def facet_counts(assigned: DataFrame, lines: DataFrame) -> DataFrame:
    """node, own, with_below: entities assigned to the node itself, and to it or below; assigned: entity, node."""
    up = assigned.join(lines, "node").groupBy(F.col("ancestor").alias("node"))
    own = F.countDistinct(F.when(F.col("depth") == 0, F.col("entity")))
    return up.agg(own.alias("own"), F.countDistinct("entity").alias("with_below"))


def most_specific(assigned: DataFrame, lines: DataFrame) -> DataFrame:
    """assigned (entity, node, ...) without nodes that have a descendant on the same entity."""
    above = assigned.select("entity", "node").join(lines.filter("depth > 0"), "node").select("entity", F.col("ancestor").alias("node")).distinct()
    return assigned.join(above, ["entity", "node"], "left_anti")


def resolve_items(claims: DataFrame, aliases: DataFrame, items: str = "items") -> DataFrame:
    """entity, source, place, node of every listed item that an alias names; claims: entity, source, items; aliases: alias, node (null: no genre)."""
    d = claims.select("entity", "source", F.posexplode(items).alias("place", "alias"))
    return d.join(aliases, "alias", "left").select("entity", "source", "place", "alias", "node")


def agree(units: DataFrame, lines: DataFrame) -> DataFrame:
    """entity, node, role, status, confidence, rule from what several sources say.

    units: entity, unit, place, node; a unit is one distinct statement of one
    source.  With one unit, or with a node that two units share, all nodes are
    confirmed; otherwise all are suggested.  The primary node is the first one,
    if the units agree on it.
    """
    known = units.filter("node is not null")
    known = most_specific(known, lines)
    per = Window.partitionBy("entity")
    nodes = known.groupBy("entity", "node").agg(F.countDistinct("unit").alias("said"))
    total = known.groupBy("entity").agg(F.countDistinct("unit").alias("units"))
    first = known.withColumn("_p", F.row_number().over(Window.partitionBy("entity", "unit").orderBy("place", "node"))).filter("_p = 1")
    prime = first.groupBy("entity").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"))
    d = nodes.join(total, "entity").join(prime, "entity").withColumn("_most", F.max("said").over(per))
    split = (F.col("units") > 1) & (F.col("_most") < 2)
    primary = ~split & (F.col("_lo") == F.col("_hi")) & (F.col("node") == F.col("_lo"))
    whole = (F.col("units") == 1) | (F.col("said") == F.col("units"))
    return d.select(
        "entity",
        "node",
        F.when(primary, "primary").otherwise("secondary").alias("role"),
        F.when(split, "suggested").otherwise("confirmed").alias("status"),
        F.when(split, "low").when(whole, "high").otherwise("medium").alias("confidence"),
        F.when(split, "source_disagreement").when(F.col("units") == 1, "source_list_order").when(whole, "sources_agree").otherwise("partial_source_agreement").alias("rule"),
    )


def derive(items: DataFrame, lines: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """owner, node, rank, n_primary, n_items: an owner's nodes from its items'.

    items: owner, item, node, is_primary, year (null: unknown).  Nodes that the
    owner rejected, and ancestors of present ones, fall out; rank 1 leads.
    """
    if rejected is not None:
        items = items.join(rejected.select("owner", "node"), ["owner", "node"], "left_anti")
    at = F.struct(F.coalesce("year", F.lit(-1)).alias("y"), F.col("item").alias("i"))
    g = items.groupBy("owner", "node").agg(
        F.countDistinct(F.when(F.col("is_primary"), F.col("item"))).alias("n_primary"),
        F.countDistinct("item").alias("n_items"),
        F.max(F.when(F.col("is_primary"), at)).alias("_lp"),
        F.max(at).alias("_la"),
    )
    g = most_specific(g.withColumnRenamed("owner", "entity"), lines).withColumnRenamed("entity", "owner")
    w = Window.partitionBy("owner").orderBy(F.desc("n_primary"), F.col("_lp").desc_nulls_last(), F.desc("n_items"), F.desc("_la"), "node")
    return g.withColumn("rank", F.row_number().over(w)).drop("_lp", "_la")
