"""Hierarchies on the stand-in tables: regions, nations and suppliers as a three-level tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxonomy as X
from ..registry import Tables, query

NODES_SQL = """n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
               UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
               l AS (SELECT id AS node, id AS ancestor, 0 AS depth FROM n UNION ALL SELECT id, parent, 1 FROM n WHERE parent IS NOT NULL
               UNION ALL SELECT a.id, b.parent, 2 FROM n a JOIN n b ON a.parent = b.id WHERE b.parent IS NOT NULL)"""


def nodes(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = t.region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    b = t.nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))
    return a.unionByName(b).unionByName(t.supplier.select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent")))


def assigned(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("entity"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node")).distinct()


@query(f"WITH {NODES_SQL} SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM l")
def g4_lineage(t: Tables) -> DataFrame:
    return X.lineage(nodes(t)).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH {NODES_SQL} SELECT ancestor AS node, count(DISTINCT l_orderkey) FILTER (WHERE depth = 0) AS own, count(DISTINCT l_orderkey) AS with_below
           FROM lineitem JOIN l ON l.node = 's' || l_suppkey GROUP BY 1""")
def a10_facet_counts(t: Tables) -> DataFrame:
    return X.facet_counts(assigned(t), X.lineage(nodes(t)))


@query(f"""WITH {NODES_SQL} SELECT DISTINCT l_orderkey AS entity FROM lineitem JOIN l ON l.node = 's' || l_suppkey WHERE ancestor IN ('r1', 'n7')""")
def p8_descendants(t: Tables) -> DataFrame:
    wanted = t.region.filter("r_regionkey = 1").select(F.lit("r1").alias("node")).unionByName(t.nation.filter("n_nationkey = 7").select(F.lit("n7").alias("node")))
    return X.with_descendants(assigned(t), X.lineage(nodes(t)), wanted)


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type, p_partkey, unnest(string_split(p_name, ' ')) AS alias, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part)
          SELECT p_partkey AS entity, alias, place, CASE WHEN alias IN ('red', 'blue', 'green', 'small', 'large') THEN 'colour' WHEN length(alias) = 4 THEN 'four' END AS node FROM a""")
def g1_resolve_items(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("alias")).distinct()
    node = F.when(F.col("alias").isin("red", "blue", "green", "small", "large"), "colour").when(F.length("alias") == 4, "four")
    claims = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("source"), F.split("p_name", " ").alias("items"))
    d = X.resolve_items(claims, words.withColumn("node", node))
    return d.select("entity", "alias", F.col("place").cast("long").alias("place"), "node")


@query("""WITH u AS (SELECT l_orderkey AS entity, l_returnflag AS unit, 'p' || (l_partkey % 5) AS node, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2, 3),
          n AS (SELECT entity, node, count(DISTINCT unit) AS said FROM u GROUP BY 1, 2), t AS (SELECT entity, count(DISTINCT unit) AS units FROM u GROUP BY 1),
          f AS (SELECT *, row_number() OVER (PARTITION BY entity, unit ORDER BY place, node) AS k FROM u), p AS (SELECT entity, min(node) AS lo, max(node) AS hi FROM f WHERE k = 1 GROUP BY 1),
          d AS (SELECT n.*, units, lo, hi, max(said) OVER (PARTITION BY n.entity) AS most FROM n JOIN t USING (entity) JOIN p USING (entity)),
          e AS (SELECT *, units > 1 AND most < 2 AS split FROM d)
          SELECT entity, node, CASE WHEN NOT split AND lo = hi AND node = lo THEN 'primary' ELSE 'secondary' END AS role, CASE WHEN split THEN 'suggested' ELSE 'confirmed' END AS status,
                 CASE WHEN split THEN 'low' WHEN units = 1 OR said = units THEN 'high' ELSE 'medium' END AS confidence,
                 CASE WHEN split THEN 'source_disagreement' WHEN units = 1 THEN 'source_list_order' WHEN said = units THEN 'sources_agree' ELSE 'partial_source_agreement' END AS rule FROM e""")
def g3_agreement(t: Tables) -> DataFrame:
    node = F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"))
    u = t.lineitem.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("unit"), node.alias("node")).agg(F.min("l_linenumber").alias("place"))
    flat = t.part.select(F.concat(F.lit("p"), (F.col("p_partkey") % 5).cast("string")).alias("id"), F.lit(None).cast("string").alias("parent")).distinct()
    return X.agree(u, X.lineage(flat))


@query("""WITH i AS (SELECT o_custkey AS owner, o_orderkey AS item, l_partkey % 7 AS node, bool_or(l_linenumber = 1) AS is_primary, extract(year FROM max(o_orderdate)) AS year
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
          g AS (SELECT owner, node, count(DISTINCT item) FILTER (WHERE is_primary) AS n_primary, count(DISTINCT item) AS n_items,
            max(struct_pack(y := year, i := item)) FILTER (WHERE is_primary) AS lp, max(struct_pack(y := year, i := item)) AS la FROM i GROUP BY 1, 2),
          r AS (SELECT owner, node, n_primary, n_items, row_number() OVER (PARTITION BY owner ORDER BY n_primary DESC, lp DESC NULLS LAST, n_items DESC, la DESC, node) AS rank FROM g)
          SELECT * FROM r""")
def g5_derive(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("year"))
    d = o.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    items = d.groupBy("owner", F.col("o_orderkey").alias("item"), (F.col("l_partkey") % 7).alias("node")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_primary"), F.max("year").alias("year"))
    flat = t.part.select((F.col("p_partkey") % 7).alias("id"), F.lit(None).cast("long").alias("parent")).distinct()
    return X.derive(items, X.lineage(flat)).select("owner", "node", "n_primary", "n_items", "rank")
