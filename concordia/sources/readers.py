"""Sources: columnar tables, delimited and JSON seeds, stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_name, html_text


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def recordset(df: DataFrame, column: str, fields: str) -> DataFrame:
    """Rows of a JSON array of objects; fields: DDL of one object."""
    return df.select(F.inline(F.from_json(column, f"array<struct<{fields}>>")))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag, entities decoded."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return display_name(html_text(F.regexp_replace(inner, r"<[^>]*>", " ")))


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, field, value: the records a page claims (title, heading, language, links' number), with their source url."""
    title, h1 = tag_text(F.col("html"), "title"), tag_text(F.col("html"), "h1")
    lang = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang=\"([^\"]+)\"", 1))
    links = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s+href="), F.lit(0))).cast("string")
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("title", title), ("heading", h1), ("lang", lang), ("links", links))])
    return pages.select("page_id", "url", F.inline(pairs)).filter("value <> ''")


def latest_content(pages: DataFrame, url: str = "url", content: str = "html", order: str = "page_id") -> DataFrame:
    """Content-addressed cache: one row per url, its newest content's SHA-256."""
    return pages.groupBy(url).agg(F.max_by(F.sha2(content, 256), order).alias("content_hash"), F.max(order).alias(order))
