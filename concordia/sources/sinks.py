"""Sinks: partition overwrite and keyed rewrites that can be run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.relational import insert_missing, upsert


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Rewrite only the partitions that df has; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_into(df: DataFrame, path: str, target: str, keys: Sequence[str], update: bool = True) -> None:
    """The table at `path` with df's rows upserted (or only inserted), written to `target`."""
    spark = df.sparkSession
    existing = spark.read.parquet(path)
    out = upsert(existing, df, keys) if update else insert_missing(existing, df, keys)
    out.write.mode("overwrite").parquet(target)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
