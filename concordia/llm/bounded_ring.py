"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Documents hash to one of 2^SLOT_BITS places on a ring; each shard owns several
virtual nodes on it.  A place's documents belong to the next virtual node
clockwise; when that shard is full, the rest continue clockwise to the next
shard with room.  Shards hold total/shards documents each, rounded down or up,
so counts differ by one at most and most documents stay where the plain ring
puts them.

The walk around the ring works on counts by place, a table whose size is a
parameter.  Everything that grows with the data is DataFrame work: counting,
ranking within a place and looking up the rank's interval.

Cases: null text has 8 bytes and checksum 0; null doc_id hashes like a value;
repeated rows are rows of their own; rows of equal hash rank by doc_id, size
and checksum; texts of any length count by their bytes;
other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import literal_table, running_total, written

SLOT_BITS = 12


def virtual_nodes(shards: int, per_shard: int, slots: int) -> list[tuple[int, int]]:
    """(place, shard) in ring order; a shard's nodes depend on nothing but its own number."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"shard-{s}/{v}".encode()).digest()[:8], "big") % slots
    return sorted((at(s, v), s) for s in range(shards) for v in range(per_shard))


def ring_plan(counts: Mapping[int, int], shards: int, per_shard: int = 64, slots: int = 1 << SLOT_BITS) -> list[dict]:
    """Intervals of ranks within a place: place, lo, hi, shard, base (slot of rank lo in its shard).

    First every place fills its own shard in ring order, then what overflowed
    continues clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = virtual_nodes(shards, per_shard, slots)
    places = [p for p, _ in ring]
    used, plan, over = [0] * shards, [], []

    def give(place: int, lo: int, n: int, shard: int) -> int:
        k = min(n, room[shard] - used[shard])
        if k:
            plan.append({"place": place, "lo": lo, "hi": lo + k, "shard": shard, "base": used[shard]})
            used[shard] += k
        return k

    for place in sorted(counts):
        n, i = counts[place], bisect_left(places, place) % len(ring)
        k = give(place, 0, n, ring[i][1])
        if k < n:
            over.append((place, k, n - k, i))
    for place, lo, n, i in over:
        while n:
            i = (i + 1) % len(ring)
            k = give(place, lo, n, ring[i][1])
            lo, n = lo + k, n - k
    return plan


def shard_rows(docs: DataFrame, shards: int = 24, per_shard: int = 64, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), moved (not on its ring shard)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("doc_id", "text").alias("_h"),
        ).withColumn("place", F.shiftrightunsigned("_h", 64 - slot_bits).cast("int")),
        "op9-rows",
    )
    counts = {r["place"]: r["count"] for r in rows.groupBy("place").count().collect()}  # 2^slot_bits rows at most
    plan = ring_plan(counts, shards, per_shard, 1 << slot_bits) if counts else []
    by_place: dict[int, list[dict]] = {}
    for x in plan:
        by_place.setdefault(x["place"], []).append(x)
    ring = virtual_nodes(shards, per_shard, 1 << slot_bits)
    places = [p for p, _ in ring]
    table = [
        {"p": p, "own": ring[bisect_left(places, p) % len(ring)][1], "part": [{k: x[k] for k in ("lo", "hi", "shard", "base")} for x in xs]}
        for p, xs in by_place.items()
    ]
    kind = "p int, own int, part array<struct<lo:bigint,hi:bigint,shard:int,base:bigint>>"
    parts = literal_table(spark, table, kind)
    # A place's documents are ranked in cells of their own: the hash bits below the place's.
    d = rows.withColumn("_low", F.shiftleft("_h", slot_bits))
    d = running_total(d, ["place"], "_low", ["doc_id", "size", "text_crc32"], F.lit(1), "rank", 16)
    d = d.join(parts, F.col("place") == F.col("p"), "left")
    hit = F.element_at(F.filter("part", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    d = d.withColumn("_x", hit)
    return d.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_x.shard").alias("shard"),
        (F.col("_x.base") + F.col("rank") - F.col("_x.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        (F.col("_x.shard") != F.col("own")).alias("moved"),
    )
