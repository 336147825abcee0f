"""Event streams: one impression per client and half hour, ordered funnels, daily cohorts, retention, guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_S, ATTRIBUTION_S = 1800, 900


def impression_key(df: DataFrame, client: str = "client_key", subject: str = "subject_id", ts: str = "ts") -> DataFrame:
    """Column bucket: the half hour of an impression."""
    return df.withColumn("bucket", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / BUCKET_S))


def dedup_impressions(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "15 minutes") -> DataFrame:
    """First impression of every key and half hour; a stream forgets keys behind the watermark."""
    d = impression_key(df, ts=ts)
    if df.isStreaming:
        return d.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, "bucket"])
    from ..operators.relational import latest_by

    tail = [F.col(c) for c in df.columns if c.endswith("_id") and c not in keys]
    return latest_by(d, [*keys, "bucket"], [F.col(ts), *tail])


def daily_counts(df: DataFrame, by: list[str], ts: str = "ts", late: str = "15 minutes") -> DataFrame:
    """day, by..., n; a stream emits a day once the watermark has passed it."""
    d = df.withWatermark(ts, late) if df.isStreaming else df
    g = d.groupBy(F.window(ts, "1 day"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast("date").alias("day"), *by, "n")


def sliding_rate(df: DataFrame, key: str, ts: str = "ts", width: str = "10 minutes", step: str = "5 minutes", most: int = 20) -> DataFrame:
    """Windows in which a key exceeded `most` events."""
    d = df.withWatermark(ts, width) if df.isStreaming else df
    return d.groupBy(F.window(ts, width, step), key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("window.start").alias("start"), key, "n")


def quiet_periods(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Bursts of a key's events that a quiet gap ends."""
    d = df.withWatermark(ts, gap) if df.isStreaming else df
    g = d.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def newest_revision(df: DataFrame, key: str, order: str, value: str, flag: str) -> DataFrame:
    """key, value of the newest attempt whatever the order of arrival, and whether any attempt raised the flag."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.bool_or(flag).alias(flag))


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than `days` before as_of."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


STAGES = ("impression", "acceptance", "search", "visit")


def _advance(state: tuple[int, int], kind: str, at: int) -> tuple[tuple[int, int], bool]:
    """New (stage reached, start in microseconds) and whether the event counts."""
    stage, start = state
    want = STAGES.index(kind) if kind in STAGES else -1
    if want == 0 and stage < 0:
        return (0, at), True
    if want == stage + 1 and stage >= 0 and at - start <= ATTRIBUTION_S * 1_000_000:
        return (want, start), True
    return state, False


def funnel_stream(events: DataFrame, key: str = "impression_id", late: str = "15 minutes") -> DataFrame:
    """Stream of counted funnel events: key, kind, ts, in order impression, acceptance, search, visit within 15 minutes.

    State per key is two numbers; it is dropped when the watermark passes the
    attribution window.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = state.get if state.exists else (-1, 0)
        out = []
        for row in pd.concat(list(parts)).sort_values(["ts", "kind"]).itertuples(index=False):
            at, ok = _advance((int(at[0]), int(at[1])), row.kind, int(row.ts.value // 1000))
            if ok:
                out.append((k[0], row.kind, row.ts))
        state.update(at)
        until = max(at[1] // 1000 + ATTRIBUTION_S * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(int(until))
        yield pd.DataFrame(out, columns=[key, "kind", "ts"])

    kind = events.schema[key].dataType.simpleString()
    d = events.select(key, "kind", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return d.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, kind string, ts timestamp", "stage int, start long", "append", GroupStateTimeout.EventTimeTimeout
    )
