"""Scans and parsers on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Tables, query
from ..sources import readers


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def s1_scan(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice")


@query("""SELECT page_id, 'lang' AS field, lower(regexp_extract(html, '(?i)<html\\b[^>]*\\blang="([^"]+)"', 1)) AS value FROM pages WHERE regexp_matches(html, '(?i)<html\\b[^>]*\\blang="([^"]+)"')
          UNION ALL SELECT page_id, 'links', CAST(len(regexp_extract_all(html, '(?i)<a\\s+href=')) AS VARCHAR) FROM pages""")
def s3_page_records(t: Tables) -> DataFrame:
    return readers.page_records(t.pages).filter("field in ('lang', 'links')").select("page_id", "field", "value")


@query()
def s3_page_titles(t: Tables) -> DataFrame:
    return readers.page_records(t.pages).filter("field in ('title', 'heading')").select("page_id", "field", "value")


@query("""SELECT url, arg_max(sha256(html), page_id) AS content_hash, max(page_id) AS page_id FROM pages GROUP BY 1""")
def s5_content_cache(t: Tables) -> DataFrame:
    return readers.latest_content(t.pages)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def s8_recordset(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('[{"id":'), F.col("event_id").cast("string"), F.lit(',"p":'), F.col("props"), F.lit("}]"))
    d = readers.recordset(t.events.select(doc.alias("doc")), "doc", "id: bigint, p: struct<k: bigint>")
    return d.select(F.col("id").alias("event_id"), F.col("p.k").alias("k"))


@query("""SELECT event_id FROM events WHERE event_type = 'error' AND event_id > 100 ORDER BY event_id LIMIT 50""")
def s11_work_queue(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error' and event_id > 100").select("event_id").orderBy("event_id").limit(50)
