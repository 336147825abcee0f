"""Partial dates as structs of integer bounds, and editorial days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(c: Column) -> Column:
    """struct(lo, hi, approximate, kind) of 1992, 1992-05, ~1992, 1990/1994, 1990/ or /2001; null if none of these.

    lo and hi are yyyymmdd integers; an open end is null.
    """
    x = F.trim(c)
    one = r"[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?"
    approx = x.startswith("~")
    y = F.regexp_replace(x, "^~", "")
    left, right = F.split_part(y, F.lit("/"), F.lit(1)), F.split_part(y, F.lit("/"), F.lit(2))
    ranged = y.contains("/")

    def number(p: Column, month: str, day: str) -> Column:
        full = F.when(F.length(p) == 4, F.concat(p, F.lit(month + day))).when(F.length(p) == 7, F.concat(F.replace(p, F.lit("-"), F.lit("")), F.lit(day)))
        return F.when(p.rlike(f"^{one}$"), F.coalesce(full, F.replace(p, F.lit("-"), F.lit(""))).cast("int"))

    ok = y.rlike(f"^(?:{one}|{one}/(?:{one})?|/{one})$")
    until = F.when(ranged, right).otherwise(y)
    value = F.struct(
        number(F.when(ranged, left).otherwise(y), "01", "01").alias("lo"),
        number(until, "12", "31").alias("hi"),
        approx.alias("approximate"),
        F.when(ranged, "interval").when(F.length(y) == 4, "year").when(F.length(y) == 7, "month").otherwise("day").alias("kind"),
    )
    return F.when(ok, value)


def definitely_before(a: Column, b: Column) -> Column:
    """Three-valued: true if all of a lies before all of b, null where an end is open."""
    return a["hi"] < b["lo"]


def editorial_day(ts: Column, zone: str = "America/Caracas") -> Column:
    """Calendar day in the editors' zone of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def day_number(day: Column, since: str = "1970-01-01") -> Column:
    return F.datediff(day, F.lit(since).cast("date"))


def daily_index(day: Column, n: Column) -> Column:
    """Index of the day's item among n."""
    return F.pmod(day_number(day), n)
