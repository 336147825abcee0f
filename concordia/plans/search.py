"""Search, evaluation and observability on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution as E
from ..operators import search as Q
from ..registry import Tables, query

INDEX_SQL = """w AS (SELECT l_partkey, count(*) AS weight FROM lineitem GROUP BY 1), e AS (SELECT p_partkey AS entity_id, p_name AS name, coalesce(weight, 0) AS weight, lower(p_name) AS key FROM part LEFT JOIN w ON p_partkey = l_partkey)"""


def index(t: Tables) -> DataFrame:
    w = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("weight"))
    d = t.part.join(w, "p_partkey", "left").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return Q.build_index(d)


@query(f"""WITH {INDEX_SQL}, t AS (SELECT *, CASE WHEN key = 'red' THEN 0 WHEN starts_with(key, 'red') THEN 1 WHEN contains(key, ' red') THEN 2 WHEN contains(key, 'red') THEN 3 END AS tier FROM e),
           p AS (SELECT entity_id, tier, weight, row_number() OVER (ORDER BY tier, weight DESC, name, entity_id) AS place, least(count(*) OVER (), 200) AS total FROM t WHERE tier IS NOT NULL)
           SELECT entity_id, CAST(tier AS BIGINT) AS tier, weight, place, total FROM p WHERE place <= 50""")
def q2_tiers(t: Tables) -> DataFrame:
    d = Q.search(index(t), "Red", 50)
    return d.select("entity_id", F.col("tier").cast("long").alias("tier"), "weight", "place", "total")


@query(f"""WITH {INDEX_SQL}, q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS q FROM part), t AS (SELECT q.q, e.*, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 WHEN contains(key, ' ' || q) THEN 2 END AS tier FROM e, q),
           p AS (SELECT q, entity_id, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY q ORDER BY tier, weight DESC, name, entity_id) AS place FROM t WHERE tier IS NOT NULL)
           SELECT q AS qid, entity_id, tier, place FROM p WHERE place <= 10""")
def q3_search_many(t: Tables) -> DataFrame:
    q = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("qid")).distinct().withColumn("q", F.col("qid"))
    return Q.search_many(index(t), q, 10).withColumn("tier", F.col("tier").cast("long"))


@query("""SELECT key, count(*) AS n, min(event_id) AS first_seen, max(event_id) AS last_seen FROM (SELECT lower(event_type) AS key, event_id FROM events WHERE event_id % 3 = 0) GROUP BY key""")
def q4_misses(t: Tables) -> DataFrame:
    return Q.misses(t.events.select(F.col("event_type").alias("q"), (F.col("event_id") % 3).alias("results"), F.col("event_id").alias("ts")))


@query("""SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, a.p95 FROM
          (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) a FULL JOIN
          (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-12' AND event_type = 'error' GROUP BY 1) b ON a.day = b.day""")
def q5_observability(t: Tables) -> DataFrame:
    day = F.to_date("ts").alias("day")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    live = t.events.filter(F.col("ts") >= at("2024-01-10")).groupBy(day).agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
    old = t.events.filter((F.col("ts") < at("2024-01-12")) & (F.col("event_type") == "error")).groupBy(day).agg(F.count("*").alias("m"))
    return live.join(old, "day", "full").select("day", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), "p95")


@query("""WITH g AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS gold, list(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN '9' ELSE o_orderpriority END) AS pred FROM orders GROUP BY 1),
          s AS (SELECT sum(len(list_intersect(gold, pred))) AS tp, sum(len(pred) - len(list_intersect(gold, pred))) AS fp, sum(len(gold) - len(list_intersect(gold, pred))) AS fn, avg(CAST(list_sort(gold) = list_sort(pred) AS DOUBLE)) AS exact FROM g)
          SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(exact, 6) AS exact FROM s""")
def q7_evaluation(t: Tables) -> DataFrame:
    pred = F.expr("case when o_orderkey % 5 = 0 then '9' else o_orderpriority end")
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("gold"), F.collect_set(pred).alias("pred"))
    d = Q.label_metrics(g, "gold", "pred")
    return d.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("""WITH s AS (SELECT l_partkey AS c, bool_or(l_returnflag = 'R' AND l_quantity > 48) AS y, bool_or(l_returnflag = 'A' AND l_quantity > 48) AS x FROM lineitem GROUP BY 1),
          q AS (SELECT o_custkey AS qid, o_orderkey % 2000 AS c, o_orderkey % 3 AS grp, o_orderkey % 7 > 0 AS hard FROM orders),
          t AS (SELECT q.*, CASE WHEN y AND x THEN 'conflicted' WHEN y THEN 'supported' WHEN x THEN 'contradicted' ELSE 'unknown' END AS state FROM q LEFT JOIN s ON q.c = s.c),
          g AS (SELECT qid, grp, bool_and(hard) AS hard, CASE WHEN bool_or(state = 'supported') THEN 'supported' WHEN bool_and(state = 'contradicted') THEN 'contradicted' WHEN bool_or(state = 'conflicted') THEN 'conflicted' ELSE 'unknown' END AS gs FROM t GROUP BY 1, 2)
          SELECT qid, CASE WHEN bool_or(hard AND gs = 'contradicted') THEN 'not_supported' WHEN bool_or(hard AND gs = 'conflicted') THEN 'conflicted' WHEN bool_or(hard AND gs = 'unknown') THEN 'unresolved' WHEN bool_or(hard) THEN 'supported_as_attributed' ELSE 'preference_only' END AS status FROM g GROUP BY 1""")
def q8_evidence_logic(t: Tables) -> DataFrame:
    hit = lambda k: F.bool_or((F.col("l_returnflag") == k) & (F.col("l_quantity") > 48))
    s = t.lineitem.groupBy(F.col("l_partkey").alias("condition")).agg(hit("R").alias("supports"), hit("A").alias("counters"))
    q = t.orders.selectExpr("o_custkey as qid", "o_orderkey % 2000 as condition", "o_orderkey % 3 as grp", "o_orderkey % 7 > 0 as hard")
    return E.evidence_status(s, q, ["qid"])


@query("""WITH r AS (SELECT DISTINCT o_custkey % 60 AS a, o_orderkey % 60 AS b FROM orders) SELECT a, b, EXISTS (SELECT 1 FROM r s WHERE s.a = r.b AND s.b = r.a) AS mutual FROM r""")
def q9_mutual(t: Tables) -> DataFrame:
    r = t.orders.selectExpr("o_custkey % 60 as a", "o_orderkey % 60 as b").distinct()
    return Q.mutual(r)
