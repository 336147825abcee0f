"""Detectors and lexicons on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..registry import Tables, query


@query("""WITH o AS (SELECT l_returnflag AS flag, l_orderkey, l_linenumber, l_extendedprice, ln(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0),
          m AS (SELECT flag, median(x) AS med FROM o GROUP BY 1), d AS (SELECT o.flag, med, median(abs(x - med)) AS mad FROM o JOIN m ON o.flag = m.flag GROUP BY 1, 2)
          SELECT o.l_orderkey, o.l_linenumber, l_extendedprice AS price, round((x - med) / (1.4826 * mad), 4) AS z FROM o JOIN d ON o.flag = d.flag WHERE abs((x - med) / (1.4826 * mad)) >= 3.5""")
def dq_robust_outliers(t: Tables) -> DataFrame:
    d = Q.robust_outliers(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", 3.5)
    return d.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.round("z", 4).alias("z"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, max(l_linenumber) AS mx FROM lineitem GROUP BY 1),
          m AS (SELECT l_orderkey, unnest(range(1, mx + 1)) AS missing FROM g WHERE mx BETWEEN 1 AND 99)
          SELECT m.l_orderkey, CAST(m.missing AS BIGINT) AS missing FROM m JOIN g ON m.l_orderkey = g.l_orderkey WHERE NOT list_contains(have, m.missing)""")
def dq_numbering_gaps(t: Tables) -> DataFrame:
    d = Q.numbering_gaps(t.lineitem, ["l_orderkey"], "l_linenumber")
    return d.select("l_orderkey", F.explode(F.col("missing").cast("array<bigint>")).alias("missing"))


@query("""SELECT CAST(page_id AS VARCHAR) AS subject, detector FROM (
            SELECT page_id, unnest(list_concat(
              CASE WHEN regexp_matches(text, '^[ \\t]|[ \\t]$|[ \\t]{2,}|[ \\t]+[,.;:!?]') THEN ['irregular_spaces'] ELSE [] END,
              CASE WHEN regexp_matches(text, '&(?:[a-zA-Z]{2,8}|#[0-9]{2,5});') THEN ['html_entities'] ELSE [] END,
              CASE WHEN regexp_matches(text, '(?i)https?://|www\\.[a-z0-9-]+\\.') THEN ['address_in_name'] ELSE [] END,
              CASE WHEN len(text) - len(replace(text, '(', '')) <> len(text) - len(replace(text, ')', '')) OR
                        len(text) - len(replace(text, '[', '')) <> len(text) - len(replace(text, ']', '')) OR
                        len(text) - len(replace(text, '{', '')) <> len(text) - len(replace(text, '}', '')) THEN ['unclosed_signs'] ELSE [] END)) AS detector FROM (SELECT page_id, html AS text FROM pages))""")
def dq_text_hygiene(t: Tables) -> DataFrame:
    rules = {k: Q.TEXT_RULES[k] for k in ("irregular_spaces", "html_entities", "address_in_name")}
    d = Q.text_findings(t.pages, "page_id", "html", rules)
    return d.filter("detector <> 'sustained_capitals'").select("subject", "detector")


@query("""SELECT p_name, keep, n FROM (SELECT p_name, count(*) AS n, count(DISTINCT p_type) AS types,
            (list(p_partkey ORDER BY refs DESC, p_partkey))[1] AS keep FROM part JOIN (SELECT l_partkey, count(*) AS refs FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1) WHERE n > 1 AND types <= 1""")
def dq_duplicate_groups(t: Tables) -> DataFrame:
    refs = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("refs"))
    d = t.part.join(refs, "p_partkey")
    return Q.duplicate_groups(d, ["p_name"], "p_partkey", "refs", ["p_type"]).select("p_name", "keep", F.size("ids").cast("long").alias("n"))


@query("""SELECT min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS a, p_partkey AS b FROM part
          QUALIFY p_partkey > min(p_partkey) OVER (PARTITION BY p_name, p_brand)""")
def dq_equivalent_names(t: Tables) -> DataFrame:
    d = t.part.withColumn("key", T.secondary_key(F.col("p_name")))
    return Q.equal_key_pairs(d, ["key", "p_brand"], "p_partkey").select("a", "b")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events)""")
def dq_without_links(t: Tables) -> DataFrame:
    return Q.without_links(t.customer, "c_custkey", t.orders.select("o_custkey"), t.events.select("user_id")).select("c_custkey")


@query("""SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def dq_before_parent(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("o_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def dq_duplicate_credits(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH p AS (SELECT c_custkey AS source, c_custkey // 3 AS target FROM customer WHERE c_custkey > 0)
          SELECT a.source, a.target, b.target AS next FROM p a JOIN p b ON a.target = b.source""")
def dq_redirect_chains(t: Tables) -> DataFrame:
    p = t.customer.filter("c_custkey > 0").selectExpr("c_custkey as source", "c_custkey div 3 as target")
    return Q.redirect_chains(p)


@query()
def dq_field_anomalies(t: Tables) -> DataFrame:
    return Q.field_anomalies(t.documents, "doc_id", "text")


@query()
def dq_findings(t: Tables) -> DataFrame:
    gaps = Q.numbering_gaps(t.lineitem, ["l_orderkey"], "l_linenumber")
    early = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate")
    return Q.findings({
        "gaps": Q.finding(gaps, "numbering_gaps", F.col("l_orderkey"), F.to_json("missing")),
        "early": Q.finding(early, "before_parent", F.concat_ws("/", "l_orderkey", "l_linenumber"), F.col("l_shipdate")),
        "text": Q.text_findings(t.documents, "doc_id", "text"),
    })


@query("""SELECT detector, reviewed, precision FROM (SELECT l_returnflag AS detector, count(*) FILTER (WHERE l_linestatus = 'F') AS reviewed,
            round(count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount < 0.05) * 1.0 / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 6) AS precision FROM lineitem GROUP BY 1)
          WHERE reviewed >= 20 AND precision < 0.9""")
def dq_detector_precision(t: Tables) -> DataFrame:
    rev = F.count_if(F.col("l_linestatus") == "F")
    good = F.count_if((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.05))
    d = t.lineitem.groupBy(F.col("l_returnflag").alias("detector")).agg(rev.alias("reviewed"), F.round(good / F.nullif(rev, F.lit(0)), 6).alias("precision"))
    return d.filter("reviewed >= 20 and precision < 0.9")


@query("""SELECT kind, count(*) AS violations FROM (
            SELECT 'orphan_line' AS kind FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
            UNION ALL SELECT 'orphan_order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
            UNION ALL SELECT 'range' FROM lineitem WHERE l_discount > l_tax + 0.09
            UNION ALL SELECT 'duplicate_key' FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY kind""")
def doctor_checks(t: Tables) -> DataFrame:
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    a = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    b = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    c = t.lineitem.filter("l_discount > l_tax + 0.09")
    d = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
    u = part(a, "orphan_line").unionByName(part(b, "orphan_order")).unionByName(part(c, "range")).unionByName(part(d, "duplicate_key"))
    return u.groupBy("kind").agg(F.count("*").alias("violations"))
