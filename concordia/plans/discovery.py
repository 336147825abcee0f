"""Neighbours, recommendations, funnels, trends and daily choices on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import discovery as V
from ..operators import relational as R
from ..registry import Tables, query
from ..streaming import funnel as S


@query("""WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), h AS (SELECT l_partkey FROM m GROUP BY 1 HAVING count(*) <= 27),
          k AS (SELECT * FROM m WHERE l_partkey IN (SELECT l_partkey FROM h))
          SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS strength FROM k a JOIN k b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2""")
def d2_bridges_without_hubs(t: Tables) -> DataFrame:
    return V.shared_bridges(t.lineitem, "l_suppkey", "l_partkey", 27)


@query("""WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
          e AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS strength FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2),
          n AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, 1 AS strength FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey),
          r AS (SELECT a, b, 1 AS tier, strength FROM e WHERE strength >= 8 UNION ALL SELECT a, b, 2, strength FROM n UNION ALL SELECT a, b, 3, strength FROM e WHERE strength < 8),
          f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY tier, strength DESC) AS k FROM r),
          p AS (SELECT a, b, tier, strength, row_number() OVER (PARTITION BY a ORDER BY tier, strength DESC, md5(concat(b, 's')), b) AS place FROM f WHERE k = 1)
          SELECT a, b, tier, CAST(strength AS DOUBLE) AS strength, place FROM p WHERE place <= 12""")
def d4_similar_cascade(t: Tables) -> DataFrame:
    e = V.shared_bridges(t.lineitem, "l_suppkey", "l_partkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = s.withColumnRenamed("s_suppkey", "a").join(s.withColumnRenamed("s_suppkey", "b"), "s_nationkey").filter("a <> b").select("a", "b", F.lit(1).alias("strength"))
    return V.fuse_ranks([e.filter("strength >= 8"), n, e.filter("strength < 8")], 12, R.daily_order("s", F.col("b")))


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
          r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS round FROM g WHERE k = 1)
          SELECT p_partkey, p_brand, round FROM r WHERE round < 2""")
def d7_diversify(t: Tables) -> DataFrame:
    d = V.diversify(t.part, [F.desc("p_retailprice"), F.col("p_partkey")], "p_brand", "p_name", 2)
    return d.select("p_partkey", "p_brand", "round")


@query("""WITH f AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15') AS imp0, count(*) FILTER (WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15') AS acc0,
                     count(*) FILTER (WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15') AS imp1, count(*) FILTER (WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15') AS acc1
                     FROM (SELECT user_id % 4 AS user_id, event_type, ts FROM events) GROUP BY 1),
          q AS (SELECT *, (acc0 + 1.0) / (imp0 + 2) AS r0, (acc1 + 1.0) / (imp1 + 2) AS r1, concat_ws(',', CASE WHEN least(imp0, imp1) < 100 OR least(acc0, acc1) < 20 THEN 'insufficient_volume' END,
                       CASE WHEN acc0 > imp0 OR acc1 > imp1 THEN 'invalid_funnel' END) AS reasons FROM f)
          SELECT id, reasons, CASE WHEN reasons <> '' THEN NULL WHEN abs(r1 - r0) <= 1.96 * sqrt(greatest(0, r0 * (1 - r0) / (imp0 + 3) + r1 * (1 - r1) / (imp1 + 3))) THEN 'inconclusive'
                     WHEN r1 > r0 THEN 'rising' ELSE 'falling' END AS direction, round(r1 - r0, 6) AS delta FROM q""")
def d9_trend(t: Tables) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    n = lambda k, c: F.count_if((F.col("event_type") == k) & c)
    d = t.events.groupBy((F.col("user_id") % 4).alias("id")).agg(n("view", early).alias("imp0"), n("click", early).alias("acc0"), n("view", ~early).alias("imp1"), n("click", ~early).alias("acc1"))
    return V.trend(d).select("id", F.array_join("reasons", ",").alias("reasons"), "direction", F.round("delta", 6).alias("delta"))


@query("""WITH i AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1)
          SELECT CAST(i.ts AS DATE) AS day, e.event_type AS kind, count(*) AS n FROM events e JOIN i ON e.user_id = i.user_id GROUP BY 1, 2""")
def d11_funnel_daily(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "impression").otherwise(F.col("event_type"))
    e = t.events.select(F.col("user_id").alias("impression_id"), F.lit(1).alias("subject_id"), kind.alias("kind"), F.col("ts").alias("received_at"), F.lit("a").alias("exposure_config"))
    first = R.latest_by(e.filter("kind = 'impression'"), ["impression_id"], [F.col("received_at")])
    more = e.filter("kind <> 'impression'").unionByName(e.filter("kind = 'impression'").withColumn("kind", F.lit("view")))
    d = V.funnel_daily(first.unionByName(more))
    return d.filter("kind <> 'impression'").select("day", "kind", "n")


@query("""SELECT user_id, bucket, min(event_id) AS event_id FROM (SELECT *, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS bucket,
            row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 1800) ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view') WHERE rn = 1 GROUP BY 1, 2""")
def r1_dedup_impressions(t: Tables) -> DataFrame:
    d = S.dedup_impressions(t.events.filter("event_type = 'view'"), ["user_id"])
    return d.select("user_id", "bucket", "event_id")


@query("""WITH a AS (SELECT user_id, min(ts) AS view FROM events WHERE event_type = 'view' GROUP BY 1),
          b AS (SELECT a.user_id, view, min(ts) FILTER (WHERE ts >= view AND ts <= view + INTERVAL 4320 MINUTE) AS click FROM a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e ON a.user_id = e.user_id GROUP BY 1, 2),
          c AS (SELECT b.user_id, view, click, min(ts) FILTER (WHERE ts >= click AND ts <= view + INTERVAL 4320 MINUTE) AS purchase FROM b LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON b.user_id = e.user_id GROUP BY 1, 2, 3)
          SELECT user_id, view, click, purchase FROM c""")
def r2_ordered_funnel(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("event_type").alias("kind"), "ts")
    return V.attribute_within(e, ["user_id"], "view", ["click", "purchase"], 4320)


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def r4_daily_counts(t: Tables) -> DataFrame:
    return S.daily_counts(t.events, ["event_type"])


@query("""SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY""")
def r6_retention(t: Tables) -> DataFrame:
    return S.retained(t.events, "ts", "2024-01-31", 10).select("event_id", "user_id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
          SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def r7_quiet_periods(t: Tables) -> DataFrame:
    d = t.events.withColumn("ts", F.col("ts"))
    return S.quiet_periods(d, "user_id", gap="6 hours").select("user_id", "start", "n")


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, bool_or(event_type = 'error') AS incident FROM events GROUP BY 1""")
def r9_newest_revision(t: Tables) -> DataFrame:
    d = t.events.withColumn("incident", F.col("event_type") == "error")
    return S.newest_revision(d, "user_id", "event_id", "event_type", "incident")


@query("""SELECT day, event_id FROM (SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_type <> 'error', md5(concat(event_id, 'x'))) AS k FROM events) WHERE k <= 20""")
def r10_daily_sample(t: Tables) -> DataFrame:
    d = t.events.withColumn("day", F.to_date("ts"))
    return R.top_per(d, ["day"], [F.col("event_type") != "error", R.daily_order("x", F.col("event_id"))], 20, "k").select("day", "event_id")


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 5""")
def r11_rate_guard(t: Tables) -> DataFrame:
    return S.sliding_rate(t.events, "event_type", width="1 hour", step="1 hour", most=5)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE strftime(o_orderdate, '%m-%d') = '05-01' AND o_orderdate <= TIMESTAMP '2000-05-01'""")
def d16_ephemerides(t: Tables, today: str = "2000-05-01") -> DataFrame:
    d = t.orders.filter(F.col("o_orderdate") <= F.lit(today).cast("timestamp_ntz"))
    return d.filter(F.date_format("o_orderdate", "MM-dd") == today[5:]).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("""SELECT event_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, CAST((CAST(ts - INTERVAL 4 HOUR AS DATE) - DATE '1970-01-01') % 25 AS BIGINT) AS idx FROM events WHERE event_type = 'signup'""")
def d17_editorial_day(t: Tables) -> DataFrame:
    day = D.editorial_day(F.col("ts"))
    return t.events.filter("event_type = 'signup'").select("event_id", day.alias("day"), D.daily_index(day, F.lit(25)).cast("long").alias("idx"))


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND bool_and(l_quantity >= 1)""")
def d18_publishable_series(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.bool_and(F.col("l_quantity") >= 1).alias("ok"))
    return d.filter("n >= 2 and ok").drop("ok")


@query("""WITH d AS (SELECT DISTINCT ON (conv_id, start) conv_id, turn, start, total FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
            sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations) ORDER BY conv_id, start, turn),
          c AS (SELECT conv_id, turn, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), total) - start AS duration FROM d),
          p AS (SELECT * FROM c WHERE duration BETWEEN 30 AND 1800)
          SELECT conv_id, turn, CAST(duration AS BIGINT) AS duration FROM p WHERE conv_id IN (SELECT conv_id FROM p GROUP BY 1 HAVING count(*) >= 2)""")
def d14_playable_chapters(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    n = F.length("text").cast("long")
    before = F.coalesce(F.sum(n).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = R.latest_by(t.conversations.select("conv_id", "turn", before.alias("start"), F.sum(n).over(w).alias("total")), ["conv_id", "start"], [F.col("turn")])
    return V.playable(d, ["conv_id"], "turn", "start", "total").select("conv_id", "turn", "duration")


@query("""SELECT l_partkey, count(*) AS own FROM lineitem WHERE (l_suppkey, l_returnflag) NOT IN (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09) GROUP BY 1""")
def d13_scoped_credits(t: Tables) -> DataFrame:
    wide = t.lineitem.filter("l_quantity = 50 and l_discount > 0.09").select("l_suppkey", "l_returnflag")
    return t.lineitem.join(wide, ["l_suppkey", "l_returnflag"], "left_anti").groupBy("l_partkey").agg(F.count("*").alias("own"))
