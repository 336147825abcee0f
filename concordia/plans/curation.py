"""Curation rules on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curation as C
from ..registry import Tables, query


@query("""SELECT o_orderkey, year, title_year FROM (SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS year, CAST(1990 + o_custkey % 12 AS INT) AS title_year FROM orders) WHERE year <> title_year""")
def dq_title_year_against_release(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.concat(F.lit("Live "), (1990 + F.col("o_custkey") % 12).cast("string"), F.lit(" (take 3)")).alias("title"))
    return d.filter(C.title_year_differs(F.col("title"), F.col("year"))).select("o_orderkey", "year", F.get(C.years_in(F.col("title")), 0).alias("title_year"))


@query("""SELECT p_partkey FROM part WHERE 1850 + p_size * 4 < 1900 OR 1850 + p_size * 4 > 2025""")
def dq_impossible_years(t: Tables) -> DataFrame:
    return t.part.filter(C.impossible_year(1850 + F.col("p_size") * 4, 2024)).select("p_partkey")


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE extract(year FROM o_orderdate) < 1985 + c_nationkey""")
def dq_before_formation(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return d.filter(F.year("o_orderdate") < 1985 + F.col("c_nationkey")).select("o_orderkey")


@query("""SELECT doc_id, len(regexp_extract_all(text, '[\\p{Ll}][\\p{Lu}]')) >= 2 OR regexp_matches(text, '[),;]\\p{L}') AS stuck,
            regexp_matches(text, '\\p{L}') AND NOT regexp_matches(text, '\\p{Lu}') AS small FROM documents WHERE text IS NOT NULL""")
def dq_stuck_and_small(t: Tables) -> DataFrame:
    d = t.documents.filter("text is not null")
    return d.select("doc_id", C.stuck_words(F.col("text")).alias("stuck"), C.small_start(F.col("text")).alias("small"))


@query("""SELECT p_partkey, p_name || ' - ' || p_type AS title FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 25)""")
def dq_owner_in_title(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.concat_ws(" - ", "p_name", "p_type").alias("title"))
    return C.owner_in_title(d, "title", t.part.filter("p_size > 25"), "p_name").select("p_partkey", "title")


@query("""SELECT p_partkey, 2 + CAST(p_size % 2 = 0 AS INT) AS n FROM part""")
def dq_several_names(t: Tables) -> DataFrame:
    name = F.concat(F.col("p_brand"), F.lit(" & "), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" / "), F.col("p_name"))).otherwise(F.lit(" (a, b)")))
    return t.part.select("p_partkey", F.size(C.several_names(name)).alias("n"))


@query("""SELECT c.c_custkey AS person, s.s_suppkey AS organisation FROM customer c JOIN supplier s ON split_part(c_name, '#', 2) = split_part(s_name, '#', 2)
          WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def dq_person_is_organisation(t: Tables) -> DataFrame:
    """Persons whose key is an organisation's, without a link between them."""
    key = lambda c: F.split_part(c, F.lit("#"), F.lit(2))
    d = t.customer.join(t.supplier, key("c_name") == key("s_name"))
    d = d.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return d.select(F.col("c_custkey").alias("person"), F.col("s_suppkey").alias("organisation"))


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def dq_without_parts(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0)""")
def dq_missing_where_others_have(t: Tables) -> DataFrame:
    """Tracks without a duration in an album that has durations."""
    some = t.lineitem.filter("l_tax > 0").select("l_orderkey")
    return t.lineitem.filter("l_tax = 0").join(some, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) ON s_suppkey = l_suppkey""")
def dq_links_to_merged(t: Tables) -> DataFrame:
    """Links to entities that are redirects."""
    merged = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(merged, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, 1 + o_custkey % 3 + i AS track FROM orders, unnest(range(0, 3)) AS r(i) UNION ALL SELECT o_orderkey, 9 FROM orders""")
def d5_appearances(t: Tables) -> DataFrame:
    lo = 1 + F.col("o_custkey") % 3
    text = F.concat(F.lit("guitar (tracks 0"), lo.cast("string"), F.lit("-0"), (lo + 2).cast("string"), F.lit(", 9)"))
    return t.orders.select("o_orderkey", F.explode(C.track_range(text).cast("array<bigint>")).alias("track"))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b, count(*) AS same FROM
          (SELECT DISTINCT o_custkey, o_orderkey, l_linenumber, l_partkey % 3 AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) a JOIN
          (SELECT DISTINCT o_custkey, o_orderkey, l_linenumber, l_partkey % 3 AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) b
          ON a.o_custkey = b.o_custkey AND a.l_linenumber = b.l_linenumber AND a.k = b.k AND a.o_orderkey < b.o_orderkey GROUP BY 1, 2 HAVING count(*) >= 3""")
def e20_album_pairs(t: Tables) -> DataFrame:
    d = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", F.col("l_partkey") % 3)
    return C.pairs_by_positions(d, "o_custkey", "o_orderkey", ["l_linenumber", "k"])


@query("""SELECT o_orderkey, CASE WHEN died < born THEN 'dies_before_birth' WHEN year < born + 12 THEN 'too_young' WHEN year > died + CASE WHEN technical THEN 3 ELSE 0 END THEN 'after_death' END AS conflict FROM
          (SELECT o_orderkey, extract(year FROM o_orderdate) AS year, 1960 + o_custkey % 40 AS born, CASE WHEN o_custkey % 3 = 0 THEN 1985 + o_custkey % 15 END AS died, o_orderstatus = 'P' AS technical FROM orders)
          WHERE died < born OR year < born + 12 OR year > died + CASE WHEN technical THEN 3 ELSE 0 END""")
def e26_life_conflicts(t: Tables) -> DataFrame:
    d = t.orders.selectExpr("o_orderkey", "year(o_orderdate) as year", "1960 + o_custkey % 40 as born", "case when o_custkey % 3 = 0 then 1985 + o_custkey % 15 end as died", "o_orderstatus = 'P' as technical")
    return C.life_conflicts(d).select("o_orderkey", "conflict")


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS who, 1900 + CAST(l_quantity AS INT) * 13 % 120 AS year FROM lineitem WHERE l_discount > 0.09),
          w AS (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY who ORDER BY year) >= 20 THEN 1 ELSE 0 END AS fresh FROM d),
          g AS (SELECT *, sum(fresh) OVER (PARTITION BY who ORDER BY year ROWS UNBOUNDED PRECEDING) AS era FROM w)
          SELECT who, CAST(era AS BIGINT) AS era, min(year) AS first, max(year) AS last FROM g GROUP BY 1, 2""")
def e26_eras(t: Tables) -> DataFrame:
    d = t.lineitem.filter("l_discount > 0.09").selectExpr("l_suppkey as who", "1900 + cast(l_quantity as int) * 13 % 120 as year")
    return C.eras(d, "who", "year")


@query("""SELECT o_custkey, o_orderkey, place, n_all FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n_all FROM orders) WHERE place <= 20""")
def e27_compaction(t: Tables) -> DataFrame:
    return C.compact_candidates(t.orders, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "place", "n_all")


@query("""SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus""")
def m2_evidence_dedup(t: Tables) -> DataFrame:
    return C.dedup_evidence(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'impressions' WHEN 'click' THEN 'acceptances' ELSE 'review' END AS target FROM events""")
def m6_routing(t: Tables) -> DataFrame:
    return C.route(t.events, "event_type", {"view": "impressions", "click": "acceptances"}).select("event_id", "target")


@query("""SELECT event_id FROM events WHERE (event_type = 'view' AND user_id % 3 IN (0, 1)) OR (event_type = 'click' AND user_id % 3 = 2)""")
def m5_allowed_fields(t: Tables) -> DataFrame:
    d = t.events.withColumn("field", F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")))
    return C.allowed_fields(d, "event_type", "field", {"view": ["f0", "f1"], "click": ["f2"]}).select("event_id")


@query("""SELECT o_custkey, min(n) AS l_returnflag, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) o
          JOIN (SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NOT NULL GROUP BY 1 HAVING min(n) = max(n) AND count(*) >= 2""")
def m11_propagation(t: Tables) -> DataFrame:
    one = F.when(F.count_distinct("l_returnflag") == 1, F.min("l_returnflag"))
    props = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(one.alias("l_returnflag"))
    return C.propagate(t.orders, props, "o_orderkey", "o_custkey", "l_returnflag", 2)


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 5 > 0 THEN c_custkey - 1 END AS of FROM customer),
          r AS (SELECT run, 0 AS depth FROM d WHERE run NOT IN (SELECT of FROM d WHERE of IS NOT NULL) UNION ALL SELECT d.of, r.depth + 1 FROM r JOIN d ON d.run = r.run WHERE d.of IS NOT NULL)
          SELECT run, max(depth) AS depth, max(depth) % 2 = 0 AS active FROM r GROUP BY run""")
def c6_redo_chains(t: Tables) -> DataFrame:
    return C.active_undos(t.customer.selectExpr("c_custkey as run", "case when c_custkey % 5 > 0 then c_custkey - 1 end as of"), "run", "of")


@query("""SELECT c_custkey, (SELECT arg_max(o_orderkey, o_orderdate) FROM (SELECT o_custkey, o_orderkey, o_orderkey AS o_orderdate FROM orders) WHERE o_custkey = c_custkey) AS fixed_by FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0""")
def c9_stale_findings(t: Tables) -> DataFrame:
    old = t.customer.filter("c_mktsegment <> 'BUILDING'")
    now = t.customer.filter("c_acctbal < 0")
    journal = t.orders.selectExpr("o_custkey as c_custkey", "o_orderkey as run_id", "o_orderkey as id")
    return C.stale_findings(old, now, journal, "c_custkey")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_discount > 0.02), d AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_discount < 0.08)
          SELECT *, 'missing' AS drift FROM (SELECT * FROM d EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'surplus' FROM (SELECT * FROM s EXCEPT SELECT * FROM d)""")
def g6_drift(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_returnflag"]
    return C.drift(t.lineitem.filter("l_discount > 0.02").select(*key).distinct(), t.lineitem.filter("l_discount < 0.08").select(*key).distinct(), key)


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'confirmed' WHEN bool_or(o_orderstatus = 'P') THEN 'pending' ELSE 'unclassified' END AS status FROM orders GROUP BY 1""")
def g7_projection(t: Tables) -> DataFrame:
    any_ = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(F.when(any_("F"), "confirmed").when(any_("P"), "pending").otherwise("unclassified").alias("status"))


@query("""WITH g AS (SELECT l_suppkey, l_partkey % 20 AS tag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, tag) AS place FROM g WHERE n >= 3)
          SELECT l_suppkey, tag, place, CASE WHEN n >= 40 THEN 'strong' ELSE 'weak' END AS bucket FROM r WHERE place <= 5""")
def g10_tag_import(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("tag")).agg(F.count("*").alias("n"))
    return C.import_tags(d, "l_suppkey", "tag", "n", 3, 40, 5)


@query("""WITH h AS (SELECT DISTINCT l_partkey, l_suppkey % 7 AS label FROM lineitem)
          SELECT l_partkey, count(*) AS n_labels FROM h WHERE l_partkey IN (SELECT l_partkey FROM h WHERE label IN (1, 2) GROUP BY 1 HAVING count(*) = 2) AND l_partkey NOT IN (SELECT l_partkey FROM h WHERE label = 5) GROUP BY 1""")
def d6_constrained(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_partkey", (F.col("l_suppkey") % 7).alias("label"))
    some = lambda *xs: t.spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in xs])).alias("label"))
    return C.constrained(d, "l_partkey", "label", some(1, 2), some(5))


@query("""SELECT o_custkey, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0 / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0), 6) AS pertinence,
          round(count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) * 1.0 / count(*), 6) AS coverage, round(count(DISTINCT o_orderpriority) * 1.0 / count(*), 6) AS diversity,
          count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) = 0 AS abstains FROM orders GROUP BY 1""")
def d8_recommendation_metrics(t: Tables) -> DataFrame:
    relevant = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    d = C.recommendation_metrics(t.orders.withColumn("relevant", relevant).withColumn("owner", F.col("o_orderpriority")), ["o_custkey"])
    return d.select("o_custkey", "abstains", *[F.round(c, 6).alias(c) for c in ("pertinence", "coverage", "diversity")])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS label, CASE l_returnflag WHEN 'N' THEN 'approved' WHEN 'A' THEN 'rejected' ELSE 'proposed' END AS status, CAST(l_shipdate AS DATE) AS f FROM lineitem),
          v AS (SELECT * FROM a WHERE f <= DATE '2024-06-01')
          SELECT l_orderkey, l_linenumber FROM v WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM v r WHERE r.status = 'rejected' AND r.l_orderkey = v.l_orderkey AND r.label = v.label)""")
def d12_effective(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "approved").when(F.col("l_returnflag") == "A", "rejected").otherwise("proposed")
    d = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("label"), status.alias("status"), F.to_date("l_shipdate").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return C.effective(d, ["l_orderkey", "label"], F.lit("2024-06-01").cast("date")).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN k END AS target FROM customer
          LEFT JOIN (SELECT s_nationkey, s_suppkey % 40 AS r, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1, 2) ON s_nationkey = c_nationkey AND r = c_custkey % 40""")
def s10_unique_links(t: Tables) -> DataFrame:
    left = t.customer.selectExpr("c_custkey", "c_nationkey as n", "c_custkey % 40 as r")
    return C.unique_links(left, t.supplier.selectExpr("s_suppkey", "s_nationkey as n", "s_suppkey % 40 as r"), ["n", "r"], "c_custkey", "s_suppkey")


@query("""SELECT p_partkey, rank() OVER (ORDER BY strip_accents(lower(replace(p_name, 'e', 'É')))) AS place FROM part""")
def t7_collation(t: Tables) -> DataFrame:
    """Places in the order of a collation blind to case and accents: counts by key are summed over the few distinct keys, not over the rows."""
    from pyspark.sql import Window

    key = F.collate(F.replace(F.col("p_name"), F.lit("e"), F.lit("É")), "UNICODE_CI_AI")
    d = t.part.select("p_partkey", key.alias("k"))
    n = d.groupBy("k").agg(F.count("*").alias("n"))
    n = n.select(F.col("k").alias("_k"), (F.sum("n").over(Window.orderBy("k")) - F.col("n") + 1).alias("place"))
    return d.join(n, F.col("k") == F.col("_k")).select("p_partkey", "place")


@query("""SELECT p_partkey, kind FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN 'live' WHEN p_size % 4 = 1 THEN 'single' END AS kind FROM part) WHERE kind IS NOT NULL AND kind <> CASE WHEN p_size > 20 THEN 'live' ELSE 'single' END""")
def dq_type_against_title(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_size") % 4 == 0, " (Live)").when(F.col("p_size") % 4 == 1, " Single").when(F.col("p_size") % 4 == 2, " live single").otherwise(" alive")
    kind = C.declared_type(F.concat("p_name", tail), {"live": "live", "single": "single"})
    d = t.part.select("p_partkey", "p_size", kind.alias("kind"))
    return d.filter(F.col("kind") != F.when(F.col("p_size") > 20, "live").otherwise("single")).select("p_partkey", "kind")


@query("""SELECT p_partkey, 'prod. by ' || p_brand AS credit FROM part WHERE p_size % 3 = 0""")
def dq_credits_in_title(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" (prod. by "), "p_brand", F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise(" prod. by me")
    credit = C.bracketed(F.concat("p_name", tail), r"(?i)^(?:prod|feat|ft|with)\b")
    return t.part.select("p_partkey", credit.alias("credit")).filter("credit is not null")


@query("""SELECT o_orderkey, CASE WHEN s > e THEN 'ends_before_start' WHEN s > 2030 OR e > 2030 THEN 'in_the_future' WHEN s < b THEN 'before_birth' END AS why FROM
          (SELECT o_orderkey, 1990 + o_custkey % 45 AS s, CASE WHEN o_orderkey % 3 > 0 THEN 1995 + o_orderkey % 40 END AS e, 1980 + o_custkey % 30 AS b FROM orders) WHERE s > e OR s > 2030 OR e > 2030 OR s < b""")
def dq_impossible_periods(t: Tables) -> DataFrame:
    d = t.orders.selectExpr("o_orderkey", "1990 + o_custkey % 45 as s", "case when o_orderkey % 3 > 0 then 1995 + o_orderkey % 40 end as e", "1980 + o_custkey % 30 as b")
    return d.select("o_orderkey", C.impossible_period(F.col("s"), F.col("e"), 2030, F.col("b")).alias("why")).filter("why is not null")


@query("""SELECT DISTINCT c_custkey AS owner, s_suppkey AS other FROM customer JOIN supplier ON lower(s_name) = lower('supplier#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0')) WHERE c_custkey <> s_suppkey""")
def dq_alias_collisions(t: Tables) -> DataFrame:
    aliases = t.customer.select("c_custkey", F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("alias"))
    return C.name_collisions(aliases, "c_custkey", "alias", t.supplier, "s_suppkey", "s_name")


@query("""SELECT l_suppkey, count(*) AS uses FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0 GROUP BY 1 HAVING count(*) >= 3""")
def dq_unclassified_in_use(t: Tables) -> DataFrame:
    """Organisations without a class that are used all the same."""
    open_ = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("uses")).join(open_, "l_suppkey").filter("uses >= 3")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 'performer' ELSE 'technical' END AS stored FROM lineitem WHERE (l_returnflag = 'R' AND l_linestatus <> 'F') OR (l_returnflag = 'A' AND l_linestatus = 'F')""")
def dq_role_against_type(t: Tables) -> DataFrame:
    told = F.when(F.col("l_returnflag") == "R", "performer").when(F.col("l_returnflag") == "A", "technical")
    stored = F.when(F.col("l_linestatus") == "F", "performer").otherwise("technical")
    return t.lineitem.filter(told != stored).select("l_orderkey", "l_linenumber", stored.alias("stored"))
