"""Upkeep and person pairs on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles as X
from ..operators import admin as A
from ..operators import persons as P
from ..registry import Tables, query


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b, round(CAST(0.6 + CASE WHEN a.c_custkey // 2 % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN a.c_custkey // 2 % 5 = 0 THEN 0.2 ELSE 0 END AS DOUBLE), 4) AS score, 3 AS priority
          FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 0 AND a.c_custkey // 2 % 7 > 0""")
def e18_person_pairs(t: Tables) -> DataFrame:
    d = t.customer.selectExpr(
        "c_custkey as id", "concat('Ana', c_custkey div 2, if(c_custkey % 2 = 0, ' Paz', ' \"Nica\" Paz'), c_custkey div 2) as name", "cast(null as array<string>) as aliases",
        "if(c_custkey div 2 % 7 = 0, 1970 + c_custkey % 2, null) as born", "cast(null as int) as died",
        "if(c_custkey div 2 % 5 = 0, array(c_custkey div 2), array(-c_custkey)) as bands", "if(c_custkey div 2 % 3 = 0, array(c_custkey div 2), array(-c_custkey)) as albums",
        "cast(null as array<bigint>) as artists", "cast(null as array<bigint>) as colleagues",
    )
    none = t.customer.filter("c_custkey < 0").selectExpr("c_custkey as a", "c_custkey as b")
    return P.person_pairs(d, none).select("a", "b", "score", "priority")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%cold%' THEN 'calm' WHEN p_name LIKE '% rod' OR p_size % 2 = 0 THEN 'joy' END AS intent FROM part""")
def n10_query_intents(t: Tables) -> DataFrame:
    intents = [("calm", ["cold", "sin prisa"]), ("joy", ["rod", "buena fiesta"])]
    q = F.concat(F.lit("Música: "), "p_name", F.when(F.col("p_name").like("% rod"), "s").otherwise(""), F.when(F.col("p_size") % 2 == 0, " de ¡BUENA FIESTA!").otherwise(" de fiesta"))
    return t.part.select("p_partkey", X.phrase_intent(q, intents).alias("intent"))


@query("""SELECT string_agg(event_type || ':' || i || ':' || u || ':' || d, ',' ORDER BY event_type) AS signature FROM
          (SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS i, count(*) FILTER (WHERE user_id % 3 = 1) AS u, count(*) FILTER (WHERE user_id % 3 = 2) AS d FROM events GROUP BY 1)""")
def r8_change_signature(t: Tables) -> DataFrame:
    return A.change_signature(t.events.selectExpr("event_type", "element_at(array('insert', 'update', 'delete'), int(user_id % 3) + 1) as op"), "event_type", "op")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderstatus = 'P' THEN 'new' ELSE 'pending' END AS decision FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus = 'P' OR (o_orderkey % 4 = 1 AND o_custkey % 2 = 0)""")
def r12_upload_watch(t: Tables) -> DataFrame:
    known = t.orders.filter("o_orderkey % 4 > 0").selectExpr("o_orderkey", "if(o_orderstatus = 'P', null, 'title') as title", "if(o_custkey % 2 = 0, null, o_custkey) as album")
    return A.watch(t.orders, known, "o_orderkey", F.col("o_orderkey") % 4 == 1)


@query("""SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 10 < 2)""")
def v5_retention_exemption(t: Tables) -> DataFrame:
    reports = t.events.selectExpr("event_id", "element_at(array('open', 'in_progress', 'closed'), int(least(user_id % 10, 2)) + 1) as status")
    return A.purgeable(t.events, reports, "event_id", "ts", F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) < (60, 100) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 25""")
def v5_keyset_page(t: Tables) -> DataFrame:
    return A.keyset_page(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], (60, 100), 25)


@query("""SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1 HAVING count(*) >= 3""")
def v5_recent_accounts(t: Tables) -> DataFrame:
    return A.recent_accounts(t.events, "user_id", "ts", F.lit("2024-01-10").cast("timestamp"), 3)


@query("""WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40), p AS (SELECT o_orderpriority AS area, o_orderstatus = 'P' AND o_orderpriority LIKE '%U%' AS critical, l_orderkey IS NOT NULL AS hit FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
          SELECT area, count(*) AS positives, count(*) FILTER (WHERE hit) AS recovered, round(count(*) FILTER (WHERE hit) * 1.0 / count(*), 6) AS recall, round(count(*) FILTER (WHERE hit AND critical) * 1.0 / nullif(count(*) FILTER (WHERE critical), 0), 6) AS critical_recall FROM p GROUP BY 1""")
def v3_corpus_metrics(t: Tables) -> DataFrame:
    positives = t.orders.selectExpr("o_orderkey as id", "o_orderpriority as area", "o_orderstatus = 'P' and o_orderpriority like '%U%' as critical")
    d = A.corpus_metrics(positives, t.lineitem.selectExpr("l_orderkey as id", "l_quantity > 40 as documented"), ["area"])
    return d.select("area", "positives", "recovered", *[F.round(c, 6).alias(c) for c in ("recall", "critical_recall")])


@query("""SELECT 'nation' AS name, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(n_nationkey || '|' || n_name || '|' || n_regionkey), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM nation UNION ALL
          SELECT 'customer', count(*), CAST(sum(CAST('0x' || substr(md5(c_custkey || '|' || c_name), 1, 15) AS BIGINT)) AS VARCHAR) FROM customer""")
def doctor_fingerprint(t: Tables) -> DataFrame:
    return A.fingerprint({"nation": (t.nation, ["n_nationkey", "n_name", "n_regionkey"]), "customer": (t.customer, ["c_custkey", "c_name"])})
