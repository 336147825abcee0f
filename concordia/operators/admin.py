"""Signatures, watches, retention, pages and measures of a catalogue's upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_signature(journal: DataFrame, table: str, op: str) -> DataFrame:
    """One row, signature: rows inserted, updated and deleted by table; equal signatures mean that nothing changed."""
    n = journal.groupBy(F.col(table).alias("t")).agg(*[F.count_if(F.col(op) == o).cast("string").alias(o) for o in ("insert", "update", "delete")])
    each = F.struct("t", F.concat_ws(":", "t", "insert", "update", "delete").alias("s"))
    return n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]), ",").alias("signature"))


def fingerprint(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """name, n_rows, digest of tables by their columns: a sum of row hashes, so the order of rows does not matter."""
    marks = []
    for name, (d, cols) in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
        part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
        marks.append(d.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "n_rows", "digest"))
    return reduce(DataFrame.unionByName, marks)


def watch(latest: DataFrame, known: DataFrame, ident: str, full: Column) -> DataFrame:
    """ident, decision of uploads: new (never seen, or seen without a title), pending (a full album that has no album yet)."""
    seen = known.select(ident, F.col("title").alias("_t"), F.col("album").alias("_al"))
    d = latest.join(seen, ident, "left")
    decision = F.when(F.col("_t").isNull(), "new").when(full & F.col("_al").isNull(), "pending")
    return d.select(ident, decision.alias("decision")).filter("decision is not null").distinct()


def purgeable(messages: DataFrame, reports: DataFrame, ident: str, at: str, before: Column) -> DataFrame:
    """Messages older than `before` that no open report names."""
    held = reports.filter("status in ('open', 'in_progress')").select(ident)
    return messages.filter(F.col(at) < before).join(held, ident, "left_anti")


def keyset_page(d: DataFrame, keys: Sequence[str], after: Sequence[object] | None, size: int) -> DataFrame:
    """The next `size` rows, newest first, beyond the keys of the last row seen: no offset, so late pages cost no more."""
    if after is not None:
        d = d.filter(F.struct(*keys) < F.struct(*[F.lit(v).cast(d.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return d.orderBy(*[F.desc(k) for k in keys]).limit(size)


def recent_accounts(accounts: DataFrame, origin: str, at: str, since: Column, least: int) -> DataFrame:
    """origin, n of origins (address, device) from which `least` accounts or more came since a time."""
    return accounts.filter(F.col(at) >= since).groupBy(origin).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def corpus_metrics(positives: DataFrame, extractions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, positives, recovered, recall, critical_recall: expected statements (id, critical) that extractions (id, documented) recover.

    A measure over an empty denominator is null: not evaluated, never a pass.
    """
    found = extractions.filter("documented").select("id").distinct().withColumn("_hit", F.lit(True))
    hit, critical = F.col("_hit").isNotNull(), F.col("critical")
    return (
        positives.join(found, "id", "left")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("positives"),
            F.count_if(hit).alias("recovered"),
            (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("recall"),
            (F.count_if(hit & critical) / F.nullif(F.count_if(critical), F.lit(0))).alias("critical_recall"),
        )
    )
