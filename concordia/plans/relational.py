"""Scans, filters, joins, aggregates, windows, sorts and set operations on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import Tables, query

YEAR = "extract(year from o_orderdate)"


# -- predicates ---------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000""")
def p1_optional_filter(t: Tables, status: str | None = "F", least: float | None = 300000, priority: str | None = None) -> DataFrame:
    d = t.orders
    for value, cond in ((status, F.col("o_orderstatus") == status), (least, F.col("o_totalprice") >= (least or 0)), (priority, F.col("o_orderpriority") == priority)):
        if value is not None:
            d = d.filter(cond)
    return d.select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND NOT regexp_matches(p_name, '(?i)gear|bolt')""")
def p2_ilike_regex(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%RED%") & ~F.col("p_name").rlike("(?i)gear|bolt")).select("p_partkey", "p_name")


@query("""SELECT c_custkey, c_mktsegment FROM customer c
          WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')
            AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""")
def p3_exists(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    urgent, pending = o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'P'")
    return t.customer.join(urgent, "c_custkey", "left_semi").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
          GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3""")
def p4_division(t: Tables) -> DataFrame:
    wanted = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"))
    return R.divide(t.orders, "o_custkey", "o_orderpriority", wanted)


@query("""SELECT p_partkey, p_type FROM part WHERE list_contains(['SMALL', 'ECONOMY'], p_type) AND NOT list_contains(['Brand#1', 'Brand#2'], p_brand)""")
def p5_any_array(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").isin("SMALL", "ECONOMY") & ~F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", "p_type")


@query("""SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1""")
def p6_null_safe(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").filter(~F.col("quality").eqNullSafe(1)).select("doc_id", "quality")


@query("""SELECT bucket, count(*) AS n FROM (
            SELECT CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'solo' WHEN n = 2 THEN 'duo' ELSE 'group' END AS bucket
            FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey) GROUP BY bucket""")
def p7_case_bucket(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    b = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "solo").when(F.col("n") == 2, "duo").otherwise("group")
    return t.customer.join(n, "c_custkey", "left").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(floor(extract(year FROM o_orderdate) / 10.0) * 10 AS BIGINT) AS decade, CAST(extract(year FROM o_orderdate) // 4 AS BIGINT) AS quad,
                 count(*) AS n FROM orders WHERE extract(year FROM o_orderdate) >= 1990 AND extract(year FROM o_orderdate) < 2000 GROUP BY 1, 2""")
def p9_decade(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    d = t.orders.filter((y >= 1990) & (y < 2000)).select((F.floor(y / 10) * 10).alias("decade"), F.expr("cast(year(o_orderdate) div 4 as bigint)").alias("quad"))
    return d.groupBy("decade", "quad").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
          WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 19 AND event_type = 'click'""")
def p10_json_path(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.filter("event_type = 'click'").select("event_id", k.alias("k")).filter("k between 10 and 19")


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS until FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
          WHERE o_orderdate <= TIMESTAMP '1999-01-01' AND (until IS NULL OR until > TIMESTAMP '1999-01-01')""")
def p11_valid_at(t: Tables, as_of: str = "1999-01-01") -> DataFrame:
    until = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("until"))
    at = F.lit(as_of).cast("timestamp_ntz")
    d = t.orders.filter(F.col("o_orderdate") <= at).join(until, "o_orderkey", "left")
    return d.filter(F.col("until").isNull() | (F.col("until") > at)).select("o_orderkey")


@query("""SELECT o_custkey, max(struct_pack(y := extract(year FROM o_orderdate), k := o_orderkey)).k AS last_order FROM orders GROUP BY o_custkey""")
def p12_tuple_max(t: Tables) -> DataFrame:
    last = F.max(F.struct(F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("k")))
    return t.orders.groupBy("o_custkey").agg(last["k"].alias("last_order"))


@query("""SELECT c_custkey, coalesce(nullif(lower(trim(CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_mktsegment END)), ''), 'unknown') AS segment FROM customer""")
def p13_nullif_coalesce(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("unknown")).alias("segment"))


# -- joins ---------------------------------------------------------------------


@query("""SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def j1_inner_chain(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    d = per.join(t.customer, "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(m, 0) AS lines FROM customer
          LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
          LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) b ON c_custkey = b.o_custkey""")
def j2_left_preaggregated(t: Tables) -> DataFrame:
    key = F.col("o_custkey").alias("c_custkey")
    n = t.orders.groupBy(key).agg(F.count("*").alias("n"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    m = t.orders.join(lines, "o_orderkey").groupBy(key).agg(F.sum("k").alias("m"))
    d = t.customer.join(n, "c_custkey", "left").join(m, "c_custkey", "left")
    return d.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("m", F.lit(0)).alias("lines"))


@query("""SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS live, coalesce(b.n, 0) AS archived FROM
          (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 30 GROUP BY 1) a FULL JOIN
          (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' AND value < 3 GROUP BY 1) b ON a.day = b.day""")
def j3_full(t: Tables) -> DataFrame:
    day = F.to_date("ts").alias("day")
    a = t.events.filter("event_type = 'purchase' and value > 30").groupBy(day).agg(F.count("*").alias("live"))
    b = t.events.filter("event_type = 'signup' and value < 3").groupBy(day).agg(F.count("*").alias("archived"))
    return R.full_by(a, b, ["day"]).select("day", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("archived", F.lit(0)).alias("archived"))


@query("""SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS shared FROM lineitem a JOIN lineitem b
          ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 12""")
def j5_bridge_self_join(t: Tables) -> DataFrame:
    m = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    d = m.withColumnRenamed("l_suppkey", "a").join(m.withColumnRenamed("l_suppkey", "b"), "l_orderkey").filter("a < b")
    return d.groupBy("a", "b").agg(F.count("*").alias("shared")).filter("shared >= 12")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL
          (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON true""")
def j6_lateral_top1(t: Tables) -> DataFrame:
    top = R.latest_by(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return t.customer.select("c_custkey").join(top, "c_custkey", "left")


@query("""SELECT l_orderkey, l_linenumber, u.kind, u.amount FROM lineitem, LATERAL
          (VALUES ('discount', l_discount), ('tax', l_tax)) u(kind, amount) WHERE u.amount >= 0.07""")
def j7_unpivot(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").selectExpr(
        "l_orderkey", "l_linenumber", "stack(2, 'discount', l_discount, 'tax', l_tax) as (kind, amount)"
    )
    return d.filter("amount >= 0.07")


@query("""SELECT p_brand, item, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY p_brand, item""")
def j8_unnest(t: Tables) -> DataFrame:
    return t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("item")).groupBy("p_brand", "item").agg(F.count("*").alias("n"))


@query("""SELECT a.l_orderkey AS order_id, s.s_suppkey AS supplier FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey % 100 AS alt FROM lineitem) a
          JOIN supplier s ON s.s_suppkey IN (a.l_suppkey, a.alt) WHERE s.s_acctbal > 9500 GROUP BY 1, 2""")
def j9_or_join(t: Tables) -> DataFrame:
    either = F.explode(F.array_distinct(F.array(F.col("l_suppkey"), F.col("l_partkey") % 100))).alias("supplier")
    s = t.supplier.filter("s_acctbal > 9500").select(F.col("s_suppkey").alias("supplier"))
    return t.lineitem.select(F.col("l_orderkey").alias("order_id"), either).join(s, "supplier").select("order_id", "supplier").distinct()


@query("""WITH e AS (SELECT DISTINCT o_custkey % 50 AS a, o_orderkey % 50 AS b FROM orders WHERE o_custkey % 50 <> o_orderkey % 50 AND o_orderstatus = 'P')
          SELECT node, count(DISTINCT other) AS degree FROM (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY node""")
def j10_either_endpoint(t: Tables) -> DataFrame:
    e = t.orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b")).filter("a <> b").distinct()
    return R.undirected(e, "a", "b").groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree"))


@query("""SELECT user_id, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
          FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1""")
def j11_latest_as_of(t: Tables) -> DataFrame:
    d = t.events.filter(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    return R.latest_by(d, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.round("value", 4).alias("value"))


@query("""SELECT v.event_id AS view_id, count(c.event_id) AS clicks FROM events v LEFT JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click'
          AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 6 HOUR WHERE v.event_type = 'view' GROUP BY 1""")
def j12_interval_join(t: Tables) -> DataFrame:
    # An equi-join on user and time bucket: a click can only belong to its own bucket or the one before.
    width = 6 * 3600
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    v = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("at"), bucket(F.col("ts")).alias("k"))
    c = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts", F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) - 1)).alias("b"))
    on = (F.col("u") == F.col("user_id")) & (F.col("k") == F.col("b")) & (F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("interval 6 hours"))
    return v.join(c, on, "left").groupBy("view_id").agg(F.count("event_id").alias("clicks"))


@query("""SELECT CAST(p.ts AS DATE) AS day, p.event_type AS parent, count(*) AS n FROM events e JOIN events p ON p.event_id = e.event_id - 1
          WHERE e.event_type = 'purchase' GROUP BY 1, 2""")
def j13_self_reference(t: Tables) -> DataFrame:
    child = t.events.filter("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"))
    return child.join(t.events, "event_id").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("parent")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS found, o_custkey FROM pages
          JOIN orders ON o_orderkey = CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)""")
def j15_extracted_key(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("found"))
    return p.join(t.orders, F.col("found") == F.col("o_orderkey")).select("page_id", "found", "o_custkey")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey // 2 AS nxt FROM customer WHERE c_custkey > 1),
          r AS (SELECT id, nxt AS target FROM p UNION ALL SELECT r.id, p.nxt FROM r JOIN p ON r.target = p.id)
          SELECT id, min(target) AS target FROM r GROUP BY id""")
def j16_redirects(t: Tables) -> DataFrame:
    p = t.customer.filter("c_custkey > 1").selectExpr("c_custkey as id", "c_custkey div 2 as target")
    return R.follow(p, "id", "target")


# -- aggregates ----------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price,
                 min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def a1_group_by(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"),
        F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.count("*").alias("n"),
    )


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1""")
def a2_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors,
                 round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent FROM events GROUP BY 1""")
def a3_filtered(t: Tables) -> DataFrame:
    on = lambda k: F.col("event_type") == k
    return t.events.groupBy("user_id").agg(
        F.count_if(on("click")).alias("clicks"), F.count_if(on("error")).alias("errors"),
        F.round(F.coalesce(F.sum(F.when(on("purchase"), F.col("value"))), F.lit(0.0)), 4).alias("spent"),
    )


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority))[1:3], '|') AS first_three FROM orders GROUP BY 1""")
def a4_array_agg_slice(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), "|").alias("first_three"))


@query("""SELECT o_custkey, array_to_string(list(concat(o_orderkey, ':', o_orderstatus) ORDER BY o_orderkey), ',') AS doc FROM orders GROUP BY 1""")
def a5_nested_documents(t: Tables) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("doc"))


@query("""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def a6_string_agg(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("_a6")
    return t.spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM _a6 GROUP BY n_regionkey")


@query("""SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1""")
def a7_bool_aggregates(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
          FROM events GROUP BY 1""")
def a8_percentiles(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return d.select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query("""SELECT o_custkey, min(o_orderstatus) AS only_status FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1""")
def a9_having(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("only_status"), F.max("o_orderstatus").alias("m"))
    return d.filter("only_status = m").drop("m")


@query("""SELECT p_type, CASE WHEN p_size > 40 THEN NULL ELSE (p_size // 10) * 10 END AS decade, count(*) AS n FROM part GROUP BY 1, 2""")
def a11_facets(t: Tables) -> DataFrame:
    decade = F.expr("case when p_size > 40 then null else cast((p_size div 10) * 10 as int) end").alias("decade")
    return t.part.groupBy("p_type", decade).agg(F.count("*").alias("n"))


@query("""SELECT role, count(*) AS people FROM (SELECT o_custkey AS id, 'buyer' AS role FROM orders UNION SELECT user_id, event_type FROM events) GROUP BY role""")
def a12_distinct_roles(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_custkey").alias("id"), F.lit("buyer").alias("role"))
    return a.unionByName(t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("role"))).distinct().groupBy("role").agg(F.count("*").alias("people"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers""")
def a13_scalar_bundle(t: Tables) -> DataFrame:
    a = t.orders.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("buyers"))
    return a.join(t.lineitem.agg(F.count("*").alias("lines"))).select("orders", "lines", "buyers")


@query("""SELECT p.l_suppkey AS supplier, round(med, 6) AS med, round(median(abs(l_extendedprice - med)), 6) AS mad FROM lineitem p JOIN
          (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1) m ON p.l_suppkey = m.l_suppkey GROUP BY 1, med""")
def a14_median_mad(t: Tables) -> DataFrame:
    from ..operators.quality import median_mad

    d = median_mad(t.lineitem.withColumnRenamed("l_suppkey", "supplier"), ["supplier"], "l_extendedprice")
    return d.select("supplier", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("""WITH w AS (SELECT DISTINCT doc_id, source, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS token FROM documents),
          n AS (SELECT count(DISTINCT doc_id) AS n FROM w), s AS (SELECT source, count(DISTINCT doc_id) AS ns FROM w GROUP BY 1),
          d AS (SELECT token, count(*) AS df FROM w GROUP BY 1), ds AS (SELECT source, token, count(*) AS k FROM w GROUP BY 1, 2)
          SELECT source, token, k, df, round(k * n * 1.0 / (df * ns), 6) AS lift FROM ds JOIN d USING (token) JOIN s USING (source), n
          WHERE df >= 5 AND k * n >= 3 * df * ns AND length(token) > 2""")
def a15_document_frequency(t: Tables) -> DataFrame:
    from ..operators.quality import lift

    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "))
    d = lift(t.documents.select("doc_id", "source", words.alias("tokens")), "doc_id", "source", "tokens", 5, 3)
    return d.filter(F.length("token") > 2).select("source", "token", "k", "df", F.round("lift", 6).alias("lift"))


@query("""SELECT c_custkey, c_nationkey, bal, paid FROM (SELECT c_custkey, c_nationkey, round(c_acctbal * 100) AS bal,
          CAST(coalesce(round(100 * paid), 0) AS DOUBLE) AS paid FROM customer LEFT JOIN (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS paid FROM orders GROUP BY 1)
          ON c_custkey = o_custkey) WHERE bal <> paid""")
def a17_ledger_mismatch(t: Tables) -> DataFrame:
    paid = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("p"))
    d = t.customer.join(paid, "c_custkey", "left")
    d = d.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).alias("bal"), F.coalesce(F.round(100 * F.col("p")), F.lit(0.0)).alias("paid"))
    return d.filter("bal <> paid")


# -- windows -------------------------------------------------------------------


@query("""SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat(c_custkey, '2024-05-01')), c_custkey) AS rank
          FROM customer) WHERE rank <= 5""")
def w1_stratified(t: Tables, day: str = "2024-05-01") -> DataFrame:
    return R.top_per(t.customer, ["c_nationkey"], [R.daily_order(day, F.col("c_custkey")), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank")


@query("""WITH d AS (SELECT o_orderkey, CAST(floor(extract(year FROM o_orderdate) / 10.0) * 10 AS BIGINT) AS decade, o_orderpriority AS family,
                     md5(concat(o_orderkey, '2024-05-01')) AS h FROM orders),
          a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY h, o_orderkey) AS r FROM d) WHERE r <= 120),
          b AS (SELECT *, row_number() OVER (PARTITION BY decade, family ORDER BY h, o_orderkey) AS round FROM a)
          SELECT decade, family, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY round, family, h, o_orderkey) AS place FROM b) WHERE place <= 12""")
def w2_balanced_draw(t: Tables, day: str = "2024-05-01") -> DataFrame:
    from ..operators.discovery import balanced_draw

    d = t.orders.select("o_orderkey", (F.floor(F.year("o_orderdate") / 10) * 10).alias("decade"), F.col("o_orderpriority").alias("family"))
    return balanced_draw(d, "decade", "family", "o_orderkey", day, 120, 12).select("decade", "family", "o_orderkey", "place")


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def w3_lag_lead(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@query("""SELECT o_orderkey, total, of_customer FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, count(*) OVER (PARTITION BY o_custkey) AS of_customer
          FROM orders WHERE o_orderstatus = 'F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def w4_page_with_total(t: Tables) -> DataFrame:
    d = t.orders.filter("o_orderstatus = 'F'")
    d = d.withColumn("of_customer", F.count("*").over(Window.partitionBy("o_custkey")))
    page = d.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(t.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("total")))).select("o_orderkey", "total", "of_customer")


@query("""SELECT s_nationkey, s_suppkey, place FROM (SELECT *, ((row_number() OVER w - 1 - (19844 * 3) % n) % n + n) % n AS place FROM
          (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE place < 3""")
def w5_rotation(t: Tables) -> DataFrame:
    d = R.rotated(t.supplier, 19844, 3, [F.col("s_suppkey")], ["s_nationkey"])
    return d.filter("place < 3").select("s_nationkey", "s_suppkey", "place")


@query("""SELECT p_partkey, word, pos FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)""")
def w6_ordinality(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH y AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS below FROM orders),
          g AS (SELECT *, lead(below) OVER (PARTITION BY o_custkey ORDER BY below) AS above FROM y),
          r AS (SELECT *, above - below AS gap, row_number() OVER (PARTITION BY o_custkey ORDER BY above - below DESC, below) AS rn FROM g WHERE above IS NOT NULL)
          SELECT o_custkey, below, above, CAST(gap AS BIGINT) AS gap FROM r WHERE rn = 1""")
def w7_largest_gap(t: Tables) -> DataFrame:
    d = t.orders.select("o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("d"))
    back = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c)
    d = R.largest_gap(d, ["o_custkey"], "d")
    return d.select("o_custkey", back(F.col("below")).alias("below"), back(F.col("above")).alias("above"), F.col("gap").cast("long").alias("gap"))


@query("""SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), total) - start AS BIGINT) AS duration FROM
          (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
           sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)""")
def w8_chapter_durations(t: Tables) -> DataFrame:
    from ..operators.discovery import chapter_durations

    w = Window.partitionBy("conv_id")
    n = F.length("text").cast("long")
    before = F.coalesce(F.sum(n).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = t.conversations.select("conv_id", "turn", before.alias("start"), F.sum(n).over(w).alias("total"))
    return chapter_durations(d, ["conv_id"], "turn", "start", "total").select("conv_id", "turn", "start", "duration")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN gaps = 0 THEN num END, p_retailprice, p_partkey) AS pos FROM
          (SELECT *, CASE WHEN p_size > 2 THEN p_size END AS num, sum(CASE WHEN p_size > 2 THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand) AS gaps FROM part)""")
def w9_series_order(t: Tables) -> DataFrame:
    d = t.part.withColumn("num", F.when(F.col("p_size") > 2, F.col("p_size")))
    d = d.withColumn("gaps", F.max(F.col("num").isNull()).over(Window.partitionBy("p_brand")))
    w = Window.partitionBy("p_brand").orderBy(F.when(~F.col("gaps"), F.col("num")).asc_nulls_last(), "p_retailprice", "p_partkey")
    return d.select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("pos"))


@query("""SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS last7,
          count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17') AS before7 FROM events GROUP BY 1""")
def w10_two_windows(t: Tables, end: str = "2024-01-24") -> DataFrame:
    day = F.datediff(F.lit(end).cast("date"), F.to_date("ts"))
    d = t.events.select("event_type", day.alias("d"))
    return d.groupBy("event_type").agg(F.count_if(F.col("d").between(1, 7)).alias("last7"), F.count_if(F.col("d").between(8, 14)).alias("before7"))


# -- sorts and limits ------------------------------------------------------------


@query("""SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 300""")
def t1_nulls_last(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(F.col("quality").asc_nulls_last(), "doc_id").limit(300)


@query("""SELECT p_partkey, pos FROM (SELECT p_partkey, row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+$', ''),
          CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), p_partkey) AS pos FROM part) WHERE pos <= 100""")
def t2_natural_order(t: Tables) -> DataFrame:
    text, number = R.natural_keys(F.col("p_brand"))
    d = t.part.select("p_partkey", text.alias("k"), number.alias("n")).orderBy("k", "n", "p_partkey").limit(100)
    return d.select("p_partkey", F.row_number().over(Window.orderBy("k", "n", "p_partkey")).cast("long").alias("pos"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def t3_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("""SELECT n_nationkey, n_name, list_position([7, 3, 21, 0], n_nationkey) AS pos FROM nation WHERE n_nationkey IN (7, 3, 21, 0)""")
def t4_given_order(t: Tables) -> DataFrame:
    ids = F.array(*[F.lit(x) for x in (7, 3, 21, 0)])
    d = t.nation.withColumn("pos", F.array_position(ids, F.col("n_nationkey"))).filter("pos > 0")
    return d.orderBy("pos").select("n_nationkey", "n_name", "pos")


@query("""SELECT s_suppkey, s_name FROM supplier ORDER BY md5(concat(s_suppkey, '2024-05-01')) LIMIT 15""")
def t5_daily_shuffle(t: Tables, day: str = "2024-05-01") -> DataFrame:
    return t.supplier.orderBy(R.daily_order(day, F.col("s_suppkey"))).limit(15).select("s_suppkey", "s_name")


@query("""SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) WHERE i = 19844 % n""")
def t6_item_of_day(t: Tables, day: int = 19844) -> DataFrame:
    w = Window.orderBy("n_nationkey")
    d = t.nation.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return d.filter(F.col("i") == F.pmod(F.lit(day), F.col("n"))).select("n_nationkey", "n_name")


@query("""SELECT s_suppkey, round(score, 4) AS score FROM (SELECT l_suppkey AS s_suppkey, sum(l_quantity) * ln(1 + count(DISTINCT l_orderkey)) AS score FROM lineitem GROUP BY 1)
          ORDER BY score DESC, s_suppkey LIMIT 20""")
def t9_popularity(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.sum("l_quantity") * F.log(1 + F.countDistinct("l_orderkey"))).alias("score"))
    return d.orderBy(F.desc("score"), "s_suppkey").limit(20).select("s_suppkey", F.round("score", 4).alias("score"))


@query("""SELECT kind, id FROM (SELECT 'c' AS kind, c_nationkey AS id FROM customer UNION SELECT 's', s_nationkey FROM supplier UNION SELECT 'n', n_nationkey FROM nation)
          UNION ALL SELECT 'r', r_regionkey FROM region""")
def u1_unions(t: Tables) -> DataFrame:
    part = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    a = part(t.customer, "c", "c_nationkey").unionByName(part(t.supplier, "s", "s_nationkey")).unionByName(part(t.nation, "n", "n_nationkey"))
    return a.distinct().unionByName(part(t.region, "r", "r_regionkey"))


@query("""SELECT doc_id, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either FROM
          (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM documents)""")
def u2_set_arrays(t: Tables) -> DataFrame:
    a, b = F.split("text", " "), F.split(F.lower("text"), " ")
    return t.documents.select("doc_id", F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("either"))
