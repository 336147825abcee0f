"""Shared helpers: table access, durable intermediates, distributed ranks, Bloom bits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; a local one of our own only where the executors are this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._concordia_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def cleared() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written within, but for those it is told to keep."""
    _SCOPES.append([])
    safe: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        safe.append(df)
        return df

    try:
        yield keep
    finally:
        drop_written(*[x for x in _SCOPES.pop() if not any(x is y for y in safe)])
        if _SCOPES:
            _SCOPES[-1] += safe


def drop_written(*frames: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_concordia_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def literal_table(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A small, bounded driver-side table as a JVM-only plan (JSON literal, no Python rows)."""
    import json

    text = json.dumps(list(rows), separators=(",", ":"))
    arr = F.from_json(F.lit(text), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(arr))


#: Rows of two or three narrow columns that may be sent to every executor: some 100 MB.
SENT = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has SENT rows at most."""
    return F.broadcast(df) if df.count() <= SENT else df


def without(docs: DataFrame, keys: Sequence[Column], gone: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """docs less the rows whose keys are in gone; of rows whose keys are in twice one each.

    gone and twice are written tables, their columns in the order of keys.  Lists
    of SENT rows at most are sent to the texts; longer ones make Spark shuffle both.
    """
    names = [f"_k{i}{uuid.uuid4().hex[:8]}" for i in range(len(keys))]
    d = docs.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])

    def hit(df: DataFrame, table: DataFrame, how: str) -> DataFrame:
        right = sent(table).toDF(*[f"{n}g" for n in names])
        on = F.lit(True)
        for n in names:
            on &= F.col(n).eqNullSafe(F.col(f"{n}g"))
        return df.join(right, on, how)

    out = hit(d, gone, "left_anti")
    if twice is not None and twice.head(1):
        out = hit(out, twice, "left_anti").union(hit(out, twice, "left_semi").dropDuplicates(names))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: Column, out: str, buckets: int = 256
) -> DataFrame:
    """Exclusive running sum of value within keys, ordered by the long hash `order`, then ties.

    A key is cut into `buckets` ranges of the hash; only per-range totals are
    summed over a key as a whole, so a key that holds a third of all rows is
    still spread over many tasks.  df must be deterministic (a written table).
    """
    shift = 64 - int(buckets).bit_length() + 1
    d = df.withColumn("_v", value.cast("long")).withColumn("_b", F.shiftright(F.col(order), shift))
    totals = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_base"),
    )
    cond = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
        .join(base, cond, "left")
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_v", "_b", "_in", "_base", "_kb", *[f"_k{i}" for i in range(len(keys))])
    )


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """fn on each Arrow batch, without empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return run


BATCH = 1000  # rows; some MB of texts or sets


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """What is run within gets Arrow batches of `rows` rows at most: buffers in the JVM and copies in Python grow with a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def give_back() -> None:
    """Return freed memory that this process' allocators keep to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(fn: Callable) -> Callable:
    """fn of mapInArrow; workers live on between tasks, so what a task has freed is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LONG = 64  # bytes; longer words are hashed one by one
SLAB = 1 << 20


def word_hashes(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all parts, one after the other, and where each part begins (with the end at last).

    Words are cut and hashed eight bytes at a time for all parts at once.
    """
    from xxhash import xxh64_intdigest

    b = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), dtype=np.uint8)
    inner = ~SPACES[b]
    inner[-8:] = False
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    if inner[0]:
        edge = np.concatenate([[0], edge])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.lib.stride_tricks.as_strided(b, shape=(len(b) - 7, 8), strides=(1, 1))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(size <= LONG)
    for off in range(0, LONG, 8):
        at = at[size[at] > off]
        if not len(at):
            break
        x = np.ascontiguousarray(eight[start[at] + off]).view("<u8").ravel()
        short = np.minimum(size[at] - off, 8).astype(np.uint64) * np.uint64(8)
        h[at] = mix64(h[at] ^ (x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - short))))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxh64_intdigest(b[start[i] : start[i] + size[i]].tobytes())
    begin = np.cumsum([0, *[len(x) + 1 for x in parts]])
    return h, np.searchsorted(start, begin)


def word_slabs(parts: Sequence[bytes], slab: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """word_hashes() of so many parts at a time as hold about `slab` bytes, after the index of the first."""
    i = 0
    while i < len(parts):
        j, room = i, slab
        while j < len(parts) and (j == i or len(parts[j]) <= room):
            room -= len(parts[j])
            j += 1
        yield (i, *word_hashes(parts[i:j]))
        i = j


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; w must hold at least k."""
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[i : i + n]
        h ^= h >> np.uint64(29)
    return mix64(h)


MOST_BITS = 27  # 16 MB


def bloom_size(n: int) -> int:
    """log2 of the bits for n keys at about 12 a key, MOST_BITS at most; more keys only let more through."""
    return min(MOST_BITS, max(16, (12 * n - 1).bit_length()))


def bloom_bits(keys: DataFrame, hashed: Column, log2_bits: int) -> np.ndarray:
    """A Bloom filter (3 probes) of a column of 64-bit hashes, gathered by bit_or; its size is bounded whatever the data."""
    mask = (1 << log2_bits) - 1
    probes = F.array(*[F.shiftrightunsigned(hashed, 18 * i).bitwiseAND(F.lit(mask)) for i in range(3)])
    words = (
        keys.select(F.explode(probes).alias("_p"))
        .select((F.shiftright("_p", 6)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
    )
    got = words.toPandas()
    bits = np.zeros(max(1, (1 << log2_bits) >> 6), dtype=np.uint64)
    if len(got):
        bits[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def bloom_has(bits: np.ndarray, hashed: np.ndarray, log2_bits: int) -> np.ndarray:
    """Which hashes may be in the filter; never misses one that is."""
    mask, h = np.uint64((1 << log2_bits) - 1), hashed.view(np.uint64)
    hit = np.ones(len(h), dtype=bool)
    for i in range(3):
        p = (h >> np.uint64(18 * i)) & mask
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit
