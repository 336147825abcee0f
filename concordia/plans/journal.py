"""Change data on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import relational as R
from ..registry import Tables, query


def journal(t: Tables) -> DataFrame:
    """Lines of an order as changes of one row: the first inserts, the last one may delete."""
    data = lambda c: F.create_map(F.lit("flag"), F.col(c), F.lit("status"), F.col("l_linestatus"))
    op = F.when(F.col("l_linenumber") == 1, "I").when(F.col("l_linenumber") >= 7, "D").otherwise("U")
    d = t.lineitem.withColumn("op", op).withColumn("id", F.expr("2 * (l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey) + cast(l_linestatus = 'O' as int)"))
    return d.select(
        "id", (F.col("l_suppkey") % 7).alias("run_id"), F.col("l_returnflag").alias("table_name"), F.col("l_orderkey").alias("row_pk"), "op",
        F.when(F.col("op") != "I", data("l_returnflag")).alias("old_data"), F.when(F.col("op") != "D", data("l_returnflag")).alias("new_data"),
    )


JOURNAL_SQL = """j AS (SELECT 2 * (l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey) + CAST(l_linestatus = 'O' AS INT) AS id, l_suppkey % 7 AS run_id, l_returnflag AS table_name, l_orderkey AS row_pk,
                 CASE WHEN l_linenumber = 1 THEN 'I' WHEN l_linenumber >= 7 THEN 'D' ELSE 'U' END AS op, l_linestatus AS status FROM lineitem)"""


@query("""SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.p IS NOT DISTINCT FROM n.p THEN 'same' ELSE 'changed' END AS change FROM
          (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderpriority <> '1-URGENT') o FULL JOIN
          (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE o_orderpriority END AS p FROM orders WHERE o_orderpriority <> '5-LOW') n ON o.k = n.k""")
def c1_keyed_delta(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    n = t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.expr("case when o_orderkey % 9 = 0 then '0' else o_orderpriority end").alias("p"))
    return R.keyed_delta(o, n, ["k"], ["p"]).select("k", "change")


@query("""SELECT k, op, keys FROM (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'I' WHEN n.k IS NULL THEN 'D' ELSE 'U' END AS op,
            CASE WHEN o.k IS NULL OR n.k IS NULL THEN 'p,s' WHEN o.p <> n.p AND o.s <> n.s THEN 'p,s' WHEN o.p <> n.p THEN 'p' WHEN o.s <> n.s THEN 's' END AS keys FROM
          (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '1-URGENT') o FULL JOIN
          (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE o_orderstatus END AS s FROM orders WHERE o_orderpriority <> '5-LOW') n ON o.k = n.k) WHERE keys IS NOT NULL""")
def c2_row_diff(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey as k", "o_orderpriority as p", "o_orderstatus as s")
    n = t.orders.filter("o_orderpriority <> '5-LOW'").selectExpr("o_orderkey as k", "case when o_orderkey % 9 = 0 then '0' else o_orderpriority end as p", "case when o_orderkey % 4 = 0 then '0' else o_orderstatus end as s")
    d = J.snapshot_diff(o, n, ["k"], ["p", "s"])
    return d.select("k", "op", F.array_join(F.array_sort(F.map_keys(F.coalesce("new_data", "old_data"))), ",").alias("keys"))


@query(f"""WITH {JOURNAL_SQL}, w AS (SELECT *, first_value(op) OVER p AS f, last_value(op) OVER p AS l FROM j WINDOW p AS (PARTITION BY table_name, row_pk ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
          r AS (SELECT DISTINCT table_name, row_pk, f <> 'I' AS existed, l <> 'D' AS remains FROM w)
          SELECT table_name, row_pk, CASE WHEN NOT existed THEN 'remove' WHEN NOT remains THEN 'restore' ELSE 'revert' END AS step,
            CASE WHEN existed THEN (SELECT arg_min(status, id) FROM j WHERE j.table_name = r.table_name AND j.row_pk = r.row_pk AND op <> 'I') END AS before_status,
            CASE WHEN remains THEN (SELECT arg_max(status, id) FROM j WHERE j.table_name = r.table_name AND j.row_pk = r.row_pk AND op <> 'D') END AS after_status
          FROM r WHERE existed OR remains""")
def c3_net_changes(t: Tables) -> DataFrame:
    d = J.net_changes(journal(t))
    return d.select("table_name", "row_pk", "step", F.col("before")["status"].alias("before_status"), F.col("after")["status"].alias("after_status"))


@query(f"""WITH {JOURNAL_SQL}, own AS (SELECT * FROM j WHERE run_id = 3), w AS (SELECT *, first_value(op) OVER p AS f, last_value(op) OVER p AS l FROM own WINDOW p AS (PARTITION BY table_name, row_pk ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
          r AS (SELECT table_name, row_pk, f <> 'I' AS existed, l <> 'D' AS remains, max(id) AS last FROM w GROUP BY 1, 2, 3, 4)
          SELECT table_name, row_pk, CASE WHEN NOT existed THEN 'remove' WHEN NOT remains THEN 'restore' ELSE 'revert' END AS step,
            EXISTS (SELECT 1 FROM j WHERE j.table_name = r.table_name AND j.row_pk = r.row_pk AND j.run_id <> 3 AND j.id > r.last) AS blocked FROM r WHERE existed OR remains""")
def c5_undo_plan(t: Tables) -> DataFrame:
    return J.undo_plan(journal(t), 3).select("table_name", "row_pk", "step", "blocked")


@query(f"""WITH {JOURNAL_SQL}, g AS (SELECT run_id, table_name, count(*) FILTER (WHERE op = 'I') AS inserted, count(*) FILTER (WHERE op = 'U') AS updated, count(*) FILTER (WHERE op = 'D') AS deleted, count(DISTINCT row_pk) AS entities FROM j GROUP BY 1, 2),
          s AS (SELECT run_id, table_name, row_pk, min(id) AS id FROM j GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY run_id, table_name ORDER BY id) AS rn FROM s)
          SELECT g.*, f.first_entities FROM g JOIN (SELECT run_id, table_name, string_agg(row_pk, ',' ORDER BY id) AS first_entities FROM k WHERE rn <= 8 GROUP BY 1, 2) f ON g.run_id = f.run_id AND g.table_name = f.table_name""")
def c7_run_summary(t: Tables) -> DataFrame:
    return J.run_summary(journal(t)).withColumn("first_entities", F.array_join(F.transform("first_entities", lambda x: x.cast("string")), ","))


@query("""SELECT coalesce(o.f, n.f) AS fingerprint, CASE WHEN o.f IS NULL THEN 'new' WHEN n.f IS NULL THEN CASE WHEN o.st = 'resolved' THEN 'gone' ELSE 'resolved' END WHEN o.st = 'resolved' THEN 'reopened' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change FROM
          (SELECT c_custkey AS f, c_mktsegment AS h, CASE WHEN c_custkey % 4 = 0 THEN 'resolved' ELSE 'open' END AS st FROM customer WHERE c_mktsegment <> 'BUILDING') o FULL JOIN
          (SELECT c_custkey AS f, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_mktsegment END AS h FROM customer WHERE c_mktsegment <> 'MACHINERY') n ON o.f = n.f""")
def c8_findings_delta(t: Tables) -> DataFrame:
    o = t.customer.filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey as fingerprint", "c_mktsegment as content_hash", "case when c_custkey % 4 = 0 then 'resolved' else 'open' end as status")
    n = t.customer.filter("c_mktsegment <> 'MACHINERY'").selectExpr("c_custkey as fingerprint", "case when c_custkey % 6 = 0 then 'x' else c_mktsegment end as content_hash")
    return J.findings_delta(o, n)


@query("""SELECT k, p FROM (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderpriority <> '1-URGENT') UNION ALL
          SELECT o_orderkey, 'x' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def s9_insert_missing(t: Tables) -> DataFrame:
    base = t.orders.filter("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey as k", "o_orderpriority as p")
    return R.insert_missing(base, t.orders.filter("o_orderpriority <> '5-LOW'").selectExpr("o_orderkey as k", "'x' as p"), ["k"])


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderpriority <> '5-LOW' THEN 'x' ELSE o_orderpriority END AS p FROM orders""")
def s9_upsert(t: Tables) -> DataFrame:
    base = t.orders.filter("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey as k", "o_orderpriority as p")
    return R.upsert(base, t.orders.filter("o_orderpriority <> '5-LOW'").selectExpr("o_orderkey as k", "'x' as p"), ["k"])
