"""Streams over file sources give what the batch functions give."""

from pyspark.sql import functions as F

from concordia.sources import sinks
from concordia.streaming import funnel as S


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def events(spark, rows, tmp_path, name):
    """A stream with a last far-off row that moves the watermark."""
    d = spark.createDataFrame(rows, "impression_id string, kind string, s long").select("impression_id", "kind", F.timestamp_seconds(F.col("s") + 1_714_521_600).alias("ts"))
    path = str(tmp_path / name)
    d.coalesce(1).write.parquet(path)
    return spark.readStream.schema(d.schema).parquet(path), d


def test_impressions_once_per_half_hour(spark, tmp_path):
    rows = [("a", "impression", 10), ("a", "impression", 20), ("a", "impression", 2000), ("b", "impression", 30)]
    stream, batch = events(spark, rows, tmp_path, "e")
    got = run(S.dedup_impressions(stream, ["impression_id"]), "dedup")
    assert got.count() == 3 == S.dedup_impressions(batch, ["impression_id"]).count()


def test_funnel_order_and_expiry(spark, tmp_path):
    rows = [("a", "impression", 0), ("a", "acceptance", 60), ("a", "visit", 70), ("a", "search", 80), ("a", "visit", 90), ("b", "acceptance", 5), ("c", "impression", 0), ("c", "acceptance", 1000)]
    stream, _ = events(spark, rows, tmp_path, "f")
    got = sorted((r.impression_id, r.kind) for r in run(S.funnel_stream(stream), "funnel").collect())
    assert got == [("a", "acceptance"), ("a", "impression"), ("a", "search"), ("a", "visit"), ("c", "impression")]


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    path = str(tmp_path / "p")
    sinks.replace_partitions(d, path, ["day"])
    sinks.replace_partitions(d.filter("day = 'd2'").withColumn("n", F.lit(5)), path, ["day"])
    assert sorted((r.day, r.n) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 5)]


def test_quiet_gap_and_rate(spark):
    d = spark.createDataFrame([("a", s) for s in (0, 60, 4000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n for r in S.quiet_periods(d, "k").collect()) == [1, 2]
    assert S.sliding_rate(d, "k", most=1).count() >= 1
