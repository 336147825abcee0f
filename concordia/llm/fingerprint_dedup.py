"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks; each chunk is a polynomial in base 256 reduced by a
fixed 127-bit prime, and chunk hashes combine by length-shifted arithmetic
(h(ab) = h(a) * 256^|b| + h(b)), so a huge document never needs one pass over
one buffer.  Documents that share fingerprint and length are then compared
chunk by chunk: grouping the chunks by place and content streams over them, and
a group with two contents at one place is a collision that is split by its
exact texts.

Cases: null text counts as empty, empty texts are equal to each other, texts
that differ only in the case of A-Z are equal, repeated rows are rows of their
own of which one stays, a null doc_id sorts before all others; other columns may
have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_bits, bloom_has, bloom_size, cleared, drop_written, per_batch, texts, without, written

#: Fixed value: a 127-bit prime that is not a Mersenne prime, so that powers of 256 do not repeat early.
PRIME = 170141183460469231731687303715884105703
CHUNK = 1 << 15
HUGE = 1 << 21  # bytes, above which the chunks of one text are hashed side by side
KEY = ("fp_hi", "fp_lo", "n_bytes")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: bytes) -> bytes:
    """UTF-8 with A-Z in lower case; other bytes, and so other letters, stay."""
    return text.lower()


def combine(left: int, right: int, right_len: int, prime: int = PRIME) -> int:
    """Fingerprint of a concatenation from those of its parts."""
    return (left * pow(256, right_len, prime) + right) % prime


def fingerprint(text: bytes, chunk: int = CHUNK, prime: int = PRIME) -> int:
    h = 0
    for i in range(0, len(text), chunk):
        part = text[i : i + chunk]
        h = combine(h, int.from_bytes(part, "big") % prime, len(part), prime)
    return h


def _split(x: int) -> tuple[int, int]:
    hi, lo = x >> 64, x & ((1 << 64) - 1)
    return hi - (1 << 64) * (hi >> 63), lo - (1 << 64) * (lo >> 63)


def fingerprints(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME, huge: int = HUGE) -> DataFrame:
    """doc_id, t (hash of the text), fp_hi, fp_lo, n_bytes and the SHA-256 of the folded text.

    Texts above `huge` bytes are dealt out by chunks; their chunk hashes, with
    lengths and places, are all that comes together again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, t long, fp_hi long, fp_lo long, n_bytes long, text_sha256 string"
    names = ["doc_id", "t", *KEY, "text_sha256"]

    def table(first: list[pa.Array], found: list[tuple[int, int]], shas: list[str]) -> pa.RecordBatch:
        halves = [_split(x) for x, _ in found]
        cols = [[x for x, _ in halves], [y for _, y in halves], [n for _, n in found]]
        return pa.RecordBatch.from_arrays([*first, *[pa.array(c, pa.int64()) for c in cols], pa.array(shas, pa.string())], names)

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        folded = [fold(x) for x in texts(b)]
        return table([b.column("doc_id"), b.column("t")], [(fingerprint(x, chunk, prime), len(x)) for x in folded], [hashlib.sha256(x).hexdigest() for x in folded])

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [fold(x) for x in texts(b, "part")]
        prints = [(int.from_bytes(x, "big") % prime).to_bytes(16, "big") for x in parts]
        return pa.RecordBatch.from_arrays([b.column(c) for c in ("_rid", "place")] + [pa.array([len(x) for x in parts], pa.int64()), pa.array(prints, pa.binary())], ["_rid", "place", "size", "print"])

    def combined(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for parts in b.column("parts").to_pylist():
            h = n = 0
            for p in parts:  # in the order of their places
                h, n = combine(h, int.from_bytes(p["print"], "big"), p["size"], prime), n + p["size"]
            found.append((h, n))
        return table([b.column("doc_id"), b.column("t")], found, b.column("text_sha256").to_pylist())

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    short = d.filter(~long).mapInArrow(per_batch(whole), out)
    big = d.filter(long).withColumn("_rid", F.monotonically_increasing_id())
    big = big.select("_rid", "doc_id", "t", F.sha2(F.translate("text", UPPER, LOWER), 256).alias("text_sha256"), F.col("text").cast("binary").alias("_b"))
    place = F.explode(F.sequence(F.lit(0), F.floor((F.length("_b") - 1) / chunk))).alias("place")
    parts = big.select("_rid", "_b", place).select("_rid", "place", F.expr(f"substring(_b, cast(place * {chunk} + 1 as int), {chunk})").alias("part"))
    parts = parts.repartition("_rid", "place").mapInArrow(per_batch(hashed), "_rid long, place long, size long, print binary")
    parts = parts.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("place", "size", "print"))).alias("parts"))
    return short.unionByName(big.drop("_b").join(parts, "_rid").select("doc_id", "t", "text_sha256", "parts").mapInArrow(per_batch(combined), out))


def collided(docs: DataFrame, groups: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """Keys of groups (fp_hi, fp_lo, n_bytes of two or more rows) that hold unequal texts.

    Chunks of all members are grouped by key, place and content; equal chunks
    meet on the map side, so a hot group shuffles one row per task and place.
    A Bloom filter of the groups, of bounded size, keeps texts without a partner at
    home; what it lets through by chance goes in the semi join.
    """
    log2_bits = bloom_size(groups.count())
    bits = bloom_bits(groups, F.col("fp_lo"), log2_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in texts(b):
                x = fold(x)
                key = (*_split(fingerprint(x, chunk, prime)), len(x))
                if not bloom_has(bits, np.array([key[1]], dtype=np.int64).view(np.uint64), log2_bits)[0]:
                    continue
                rows += [(*key, i, x[i : i + chunk]) for i in range(0, len(x), chunk)]
                if len(rows) >= 1000:
                    yield _chunks(rows)
                    rows = []
            if rows:
                yield _chunks(rows)

    chunks = docs.select("text").mapInArrow(run, "fp_hi long, fp_lo long, n_bytes long, place long, part binary")
    seen = chunks.groupBy(*KEY, "place", "part").agg(F.lit(1).alias("one"))
    seen = seen.groupBy(*KEY, "place").agg(F.count("*").alias("n")).filter("n > 1")
    return seen.join(groups.select(*KEY), list(KEY), "left_semi").select(*KEY).distinct()


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*KEY, "place", "part"]
    )


def verdicts(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME, huge: int = HUGE) -> DataFrame:
    """exact_dedup() with t, the hash of the text."""
    rows = written(fingerprints(docs, chunk, prime, huge).withColumn("_rid", F.monotonically_increasing_id()), "op5-prints")
    shared = written(rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1"), "op5-shared")
    unequal = written(collided(docs, shared, chunk, prime), "op5-collided")
    drop_written(shared)
    same = [F.col(k) for k in KEY]
    if unequal.head(1):  # fingerprints of unequal texts met: their groups are split by SHA-256 as well
        rows = rows.join(unequal.withColumn("_bad", F.lit(True)), list(KEY), "left")
        rows = rows.withColumn("_exact", F.when(F.col("_bad"), F.col("text_sha256")).otherwise("")).drop("_bad")
    else:
        rows = rows.withColumn("_exact", F.lit(""))
    same.append(F.col("_exact"))
    groups = written(
        rows.groupBy(*same)
        .agg(
            F.count("*").alias("group_size"),
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("_rid", "doc_id"), F.max("_rid")).alias("_keep"),
        )
        .filter("group_size > 1"),
        "op5-groups",
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, [*KEY, "_exact"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_rid") == F.col("_keep"))).alias("kept"),
        "text_sha256",
        "t",
    )


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME, huge: int = HUGE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of rows that also
    share it, one.
    """
    return verdicts(docs, chunk, prime, huge).drop("t")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    cell = ["doc_id", "t"]
    with cleared() as keep:
        got = written(verdicts(docs).filter("group_size > 1"), "op5-verdict").groupBy(*cell).agg(F.bool_or("kept").alias("stay"), F.count("*").alias("n"))
        gone = keep(written(got.filter("not stay").select(*cell), "op5-gone"))
        twice = keep(written(got.filter("stay and n > 1").select(*cell), "op5-twice"))
    return without(docs, [F.col("doc_id"), F.xxhash64("text")], gone, twice)
