"""Exact n-gram Jaccard self-join by size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct five-word shingles.  Two sets with
100 * |A & B| >= 80 * |A | B| share several of the first shingles of each in
any common order (`prefix`), so a shingle of that prefix and a band of sizes
name a tile, and only sets of one tile can link.  Within a tile, the bits in
which two hashed bitmaps differ bound the overlap from above; what passes is
decided by exact intersection of the sorted arrays.

Prefix shingles are shuffled once, packed into arrays of 32 bits a shingle and
64 a set (`shared_tokens`); shingles of one set go no further.  A truncated
shingle only ever adds candidates.  Tiles with the same sets count once.

Hot groups: equal sets are one node.  Every tile first links its sets to two
leaders only, and sets already in one component need no more comparing, so the
tiles of a large group of near copies mostly vanish before their pairs are
made.  Tiles that stay large are cut into blocks, and shingles that are hot
within a task are dealt out by set, leaving witnesses at home.  The order puts
shingles that many documents share last (fixed-size counters over all
documents; they steer work, not results), so passages that many documents
share make few tiles.

Cases: doc_id is of an integer type; null and empty texts and texts of white
space only have n_shingles 0 and their own doc_id as component_id; a text of
fewer than five words is one shingle; equal sets link; repeated rows get a row
each; rows of one doc_id and different texts are linked each by its own text, and
need not share a component; very long texts are read whole, in one worker's memory; other columns
may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_bits, bloom_has, bloom_size, cleared, distinct, drop_written, gram_hashes, lean, small_batches, texts, without, word_slabs, written

WORDS = 5
NUM, DEN = 80, 100
FINE = 6  # bits a shingle of the bitmaps that candidate pairs are held against
NONE = -(1 << 63)  # stands for a null doc_id
BUCKETS = 1 << 18  # counters of shingles
STEPS = 4  # sizes are told apart in steps of (DEN / NUM) ** (1 / STEPS)


def shingle_sets(parts: Sequence[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles (of the whole sequence, if shorter)."""
    for _, w, begin in word_slabs([x.lower() for x in parts]):
        g = gram_hashes(w, k) if len(w) >= k else w[:0]
        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield distinct(g[s : e - k + 1]) if e - s >= k else gram_hashes(w[s:e], e - s) if e > s else w[:0]


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], k))


def set_key(h: np.ndarray, seed: int = 0) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(h.tobytes(), seed)
    return x - (1 << 64) * (x >> 63)


def bitmap(h: np.ndarray, per: int = 1) -> bytes:
    """Bits h mod 2^b, b by the set's size: `per` to twice as many bits a shingle, 64 at least."""
    b = max(6, int(per * len(h) - 1).bit_length())
    bits = np.zeros(1 << b, dtype=bool)
    bits[(h & np.uint64((1 << b) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold_bits(bits: int, size: int, to: int) -> int:
    """A bitmap of `size` bytes as one of `to` bytes, both powers of two."""
    while size > to:
        size //= 2
        bits = (bits | (bits >> (8 * size))) & ((1 << (8 * size)) - 1)
    return bits


def overlap_bound(n: int, a: bytes, m: int, b: bytes) -> int:
    """The most that sets of n and m shingles can share: their bitmaps differ in no more bits than the sets in shingles."""
    x, y, to = int.from_bytes(a, "little"), int.from_bytes(b, "little"), min(len(a), len(b))
    return (n + m - (fold_bits(x, len(a), to) ^ fold_bits(y, len(b), to)).bit_count()) // 2


def enough(over: int, n: int, m: int) -> bool:
    return DEN * over >= NUM * (n + m - over)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    return enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def size_step(n: int) -> int:
    """Steps of size; sets that link are STEPS of them apart at most, and so in the same band of STEPS or in neighbours."""
    return int(np.log(n) / np.log(DEN / NUM) * STEPS + 1e-9)


def _ids(b: pa.RecordBatch) -> list[int]:
    return [NONE if x is None else int(x) for x in b.column("doc_id").to_pylist()]


def _batch(rows: list[tuple], spec: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in spec]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, spec, strict=True)], [n for n, _ in spec])


# -- signatures and counters ---------------------------------------------------


def signatures(docs: DataFrame, k: int = WORDS, seed: int = 0) -> DataFrame:
    """doc_id, t (hash of the text), n, k1 and k2 (keys of the set) of every document; a row with n = -1 holds the shingle counters of a task."""
    spec = [("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("counters", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            rows, seen = [], []
            for i, t, h in zip(_ids(b), b.column("t").to_pylist(), shingle_sets(texts(b), k), strict=True):
                rows.append((i, t, len(h), set_key(h, seed), set_key(h, seed + 1), None) if len(h) else (i, t, 0, 0, 0, None))
                seen.append((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
                if len(seen) > 1000:
                    count += np.bincount(np.concatenate(seen), minlength=BUCKETS)
                    seen.clear()
            if rows:
                count += np.bincount(np.concatenate([*seen, np.zeros(0, np.int64)]), minlength=BUCKETS)
                yield _batch(rows, spec)
        if count.any():
            yield _batch([(None, None, -1, 0, 0, _packed_counts(count))], spec)

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, t long, n long, k1 long, k2 long, counters binary")


def _packed_counts(count: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(count.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _counts(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def summed(counters: DataFrame, fan: int = 32) -> np.ndarray:
    """The sum of all tasks' counters, by a tree of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for x in b.column("counters").to_pylist():
                total += _counts(x)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([_packed_counts(total)], pa.binary())], ["counters"])

    d = counters.select("counters")
    while (n := d.count()) > fan:
        d = written(d.repartition(-(-n // fan)).mapInArrow(lean(run), "counters binary"), "op8-counters")
    return sum((_counts(r.counters) for r in d.collect()), np.zeros(BUCKETS, dtype=np.int64))  # `fan` rows at most


def shared_levels(count: np.ndarray) -> np.ndarray:
    """How far each counter stands out above what chance gives it, in powers of two.

    Chance is the median with eight times the usual spread around it; that grows
    with the root of the data, so a passage stands out at any size once that
    many documents share it.
    """
    mid = float(np.median(count))
    over = (count - mid) / (8 * (np.sqrt(mid) + 1.5 * float(np.median(np.abs(count - mid))) + 1))
    return np.where(over > 1, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.uint8)


# -- prefixes and tiles --------------------------------------------------------


def shared_at_least(n: int) -> int:
    """How many shingles of its prefix a set of n shingles shares with any partner of its size or more."""
    return max(1, n // 24)


def prefix(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles, rarely shared ones first, of which every linked partner has shared_at_least() or more.

    At most n - ceil(0.8 n) shingles are not the partner's, so so many more
    than those hold that number of common ones; they are the first common ones
    in the common order, and so lie in the partner's prefix as well.
    """
    n = len(h)
    p = min(n, n - -(-NUM * n // DEN) + shared_at_least(n))
    level = levels[(h >> np.uint64(40)).astype(np.int64) & (len(levels) - 1)]
    if not level.any():
        return h[:p]
    return h[np.lexsort((h, level))[:p]]


HOT = 256  # sets of a shingle in one flush, above which they are dealt out


def packed_prefixes(docs: DataFrame, levels: np.ndarray, buckets: int, k: int = WORDS, seed: int = 0, flush: int = 1 << 20) -> DataFrame:
    """bucket, home, t, k, q: arrays of shingles (bits within the bucket), set keys and size steps.

    Rows with home hold what belongs to the bucket; the others hold sets of
    shingles that are shared for certain (t has the bucket's bits as well) and
    are dealt out anywhere.  Two sets of each such shingle and size step stay at
    home, so whatever has a partner among all sets has one there.
    """
    spec = [("bucket", pa.int32()), ("home", pa.bool_()), ("t", pa.binary()), ("k", pa.binary()), ("q", pa.binary())]

    def pack(tok: np.ndarray, key: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        t = ((tok % np.uint64(buckets)) << np.uint64(32)) | (tok >> np.uint64(32))
        order = np.argsort(t, kind="stable")
        t, key, q = t[order], key[order], q[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(t)))
        away = np.repeat(size > HOT, size)
        if away.any():
            at = np.flatnonzero(away)
            at = at[np.lexsort((key[at], q[at], t[at]))]
            same = lambda x: np.concatenate([[False], x[at][1:] == x[at][:-1]])
            group = same(t) & same(q)
            again = group & same(key)
            at, group = at[~again], group[~again]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(group, 0, np.arange(len(at))))
            away[at[rank < 2]] = False
            dealt = at[rank >= 2]
        else:
            dealt = np.zeros(0, dtype=np.int64)
        rows = []
        home = np.flatnonzero(~away)
        b = (t[home] >> np.uint64(32)).astype(np.int64)
        for s, e in _runs(b):
            w = home[s:e]
            rows.append((int(b[s]), True, t[w].astype(np.uint32).tobytes(), key[w].tobytes(), q[w].tobytes()))
        if len(dealt):
            b = (key[dealt].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, dealt = b[order], dealt[order]
            for s, e in _runs(b):
                w = dealt[s:e]
                rows.append((int(b[s]), False, t[w].tobytes(), key[w].tobytes(), q[w].tobytes()))
        return _batch(rows, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tok, key, q, n = [], [], [], 0

        def drained(parts: list[np.ndarray]) -> np.ndarray:
            whole = np.concatenate(parts)
            parts.clear()
            return whole

        for b in batches:
            for h in shingle_sets(texts(b), k):
                if not len(h) or (x := set_key(h, seed)) in seen:  # its rows are there already
                    continue
                if len(seen) < 1 << 20:
                    seen.add(x)
                t = prefix(h, levels)
                tok.append(t)
                key.append(np.full(len(t), x, dtype=np.int64))
                q.append(np.full(len(t), size_step(len(h)), dtype=np.uint8))
                n += len(t)
                if n >= flush:
                    yield pack(*map(drained, (tok, key, q)))
                    n = 0
        if n:
            yield pack(*map(drained, (tok, key, q)))

    return docs.select("text").mapInArrow(lean(run), "bucket int, home boolean, t binary, k binary, q binary")


def _runs(b: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every run of equal values."""
    if not len(b):
        return []
    edge = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


def shared_tokens(packed: DataFrame) -> DataFrame:
    """token, k1, q of the shingles that two or more sets of like size have in their prefixes; hot ones may come twice."""
    spec = ["token", "k1", "q"]

    def rows(token: np.ndarray, key: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key), pa.array(q.astype(np.int32))], spec)

    def close(bucket: int, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        t, key, q = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*parts, strict=True), (np.uint32, np.int64, np.uint8), strict=True))
        order = np.argsort(t)
        s = t[order]
        same = s[1:] == s[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        order = order[np.lexsort((key[order], q[order], t[order]))]
        t, key, q = t[order], key[order], q[order].astype(np.int32)
        fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]) if len(t) else np.zeros(0, dtype=bool)
        t, key, q = t[fresh], key[fresh], q[fresh]
        near = (t[1:] == t[:-1]) & (q[1:] - q[:-1] <= STEPS)
        ok = np.concatenate([[False], near]) | np.concatenate([near, [False]]) if len(t) else fresh
        if ok.any():
            return rows((np.uint64(bucket) << np.uint64(32)) | t[ok].astype(np.uint64), key[ok], q[ok])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, home, t, key, q in zip(*[b.column(c).to_pylist() for c in ("bucket", "home", "t", "k", "q")], strict=True):
                if not home:
                    yield rows(np.frombuffer(t, np.uint64), np.frombuffer(key, np.int64), np.frombuffer(q, np.uint8))
                    continue
                if bucket != now and parts:
                    if out := close(now, parts):
                        yield out
                    parts = []
                now = bucket
                parts.append((t, key, q))
        if parts and (out := close(now, parts)):
            yield out

    ordered = packed.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(lean(run), "token long, k1 long, q int")


def least_shared(q: Column) -> Column:
    """A set with fewer shared shingles than any partner of 0.8 times its size or more must share has no partner."""
    n = F.pow(F.lit(DEN / NUM), q / STEPS)
    return F.greatest(F.lit(1), F.floor((NUM / DEN * n - 1e-6) / 24))


def distinct_tiles(found: DataFrame) -> DataFrame:
    """found without sets that cannot have a partner, and with one shingle only of those that the same sets share.

    Which sets share a shingle is told by their number and two sums of hashes of their keys.
    """
    many = found.groupBy("k1").agg(F.count("*").alias("c"), F.max("q").alias("q")).filter(F.col("c") >= least_shared(F.col("q"))).select("k1")
    left = written(found.join(many, "k1", "left_semi"), "op8-left")
    hashes = [F.sum(F.shiftright(F.xxhash64("k1", F.lit(i)), 8).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    group = left.groupBy("token").agg(F.count("*").alias("size"), F.min("k1").alias("lo"), F.max("k1").alias("hi"), *hashes).filter("lo < hi")
    keep = group.groupBy("size", "lo", "hi", "s1", "s2").agg(F.min("token").alias("token")).select("token")
    out = written(left.join(keep, "token", "left_semi").select("token", "k1", F.floor(F.col("q") / STEPS).cast("int").alias("band")), "op8-tiles")
    drop_written(left)
    return out


# -- pairs ---------------------------------------------------------------------

PAIR = ("a1", "b1")


def bounded(pairs: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Pairs that the fine bitmaps allow; with best, of the pairs of each set b1 the one of greatest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            over = [overlap_bound(n, x, m, y) for n, x, m, y in zip(d["a_n"], d["a_fine"], d["b_n"], d["b_fine"], strict=True)]
            ok = [enough(o, n, m) for o, n, m in zip(over, d["a_n"], d["b_n"], strict=True)]
            if any(ok):
                yield b.select(list(PAIR)).append_column("over", pa.array(over, pa.int64())).filter(pa.array(ok))

    side = lambda s: sets.select(F.col("k1").alias(f"{s}1"), F.col("n").alias(f"{s}_n"), F.col("fine").alias(f"{s}_fine"))
    got = pairs.join(side("a"), "a1").join(side("b"), "b1").select(*PAIR, "a_n", "a_fine", "b_n", "b_fine").mapInArrow(lean(run), "a1 long, b1 long, over long")
    if best:
        got = got.groupBy("b1").agg(F.max_by("a1", F.struct("over", "a1")).alias("a1"))
    return got.select(*PAIR)


def of_sets(docs: DataFrame, reps: DataFrame, k: int, seed: int, make: str) -> DataFrame:
    """k1, n and `make` (bitmaps or arrays) of the sets in reps (k1, rep), from the text of one document of each.

    A Bloom filter of bounded size spares most other texts the work; what it lets through goes in the semi join.
    """
    log2_bits = bloom_size(reps.count())
    bits = bloom_bits(reps, F.xxhash64("rep"), log2_bits)
    spec = [("rep", pa.int64()), ("k1", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in make.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(bloom_has(bits, b.column("h").to_numpy(zero_copy_only=False), log2_bits))
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            rows = []
            for i, h in zip(b.column("doc_id").to_pylist(), shingle_sets(texts(b), k), strict=True):
                if len(h):
                    rows.append((i, set_key(h, seed), len(h), *((h.tobytes(),) if make == "array" else (bitmap(h), bitmap(h, FINE)))))
                if len(rows) >= 500:
                    yield _batch(rows, spec)
                    rows = []
            if rows:
                yield _batch(rows, spec)

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))
    narrow = docs.select(ids.alias("doc_id"), F.xxhash64(ids).alias("h"), "text")
    got = narrow.mapInArrow(lean(run), "rep long, k1 long, n long, " + ", ".join(f"{c} binary" for c in make.split()))
    got = got.join(reps.select("k1", "rep"), ["k1", "rep"], "left_semi")
    return got.dropDuplicates(["k1"]).drop("rep")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, seed: int) -> DataFrame:
    """Pairs that link, by their sorted arrays; only texts of sets that occur in pairs are read into arrays."""
    keys = _either(pairs)
    some = written(reps.join(keys, "k1", "left_semi"), "op8-reps")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [
                links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(b.column("a_h").to_pylist(), b.column("b_h").to_pylist(), strict=True)
            ]
            if any(ok):
                yield b.select(list(PAIR)).filter(pa.array(ok))

    got = written(of_sets(docs, some, k, seed, "array"), "op8-arrays")
    side = lambda s: got.select(F.col("k1").alias(f"{s}1"), F.col("array").alias(f"{s}_h"))
    both = pairs.join(side("b"), "b1").join(side("a"), "a1")
    out = written(both.select(*PAIR, "a_h", "b_h").mapInArrow(lean(check), "a1 long, b1 long"), "op8-links")
    drop_written(got, some)
    return out


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(*PAIR)).alias("k1")).distinct()


def labels(edges: DataFrame, reps: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """k1, rep, lab of every set with an edge: the smallest rep it reaches; here a set's rep is its smallest doc_id with its key.

    Each round takes the least of the neighbours' labels and of the own label's
    label, so long chains take a logarithmic number of rounds.  start: labels
    from fewer edges.
    """
    both = written(edges.union(edges.select("b1", "a1")).distinct(), "op8-edges")
    lab = reps.join(_either(edges), "k1", "left_semi").select("k1", F.struct(F.col("rep").alias("d"), F.col("k1").alias("k")).alias("rep"))
    if start is not None:
        lab = lab.join(start.select("k1", F.col("lab").alias("_s")), "k1", "left").select("k1", "rep", F.coalesce("_s", "rep").alias("lab"))
    else:
        lab = lab.withColumn("lab", F.col("rep"))
    lab = written(lab, "op8-labels")
    while True:
        near = both.join(lab.select(F.col("k1").alias("a1"), "lab"), "a1").groupBy(F.col("b1").alias("k1")).agg(F.min("lab").alias("_near"))
        root = lab.groupBy("rep").agg(F.min("lab").alias("_top")).withColumnRenamed("rep", "_of")
        nxt = lab.join(root, F.col("lab") == F.col("_of"), "left").join(near, "k1", "left")
        nxt = written(nxt.select("k1", "rep", F.col("lab").alias("_old"), F.least("lab", "_top", "_near").alias("lab")), "op8-labels")
        drop_written(lab)
        changed = nxt.filter("lab < _old").head(1)
        lab = nxt
        if not changed:
            drop_written(both)
            return lab


def open_tiles(rows: DataFrame, lab: DataFrame | None) -> DataFrame:
    """token, tile, k1, band, lab (a key of the component), size, grouped of the tiles that hold sets of more than one component.

    rows: token, k1, band.  A band's tile holds its own sets and, as guests,
    those of the band below.
    """
    if lab is None:
        d = rows.withColumn("lab", F.col("k1")).withColumn("_in", F.lit(False))
    else:
        d = rows.join(lab.select("k1", F.col("lab.k").alias("lab")), "k1", "left").withColumn("_in", F.col("lab").isNotNull())
        d = d.withColumn("lab", F.coalesce("lab", "k1"))
    d = written(d.select("*", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tile")), "op8-labelled")
    many = d.groupBy("token", "tile").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("size"), F.max("band").alias("top"), F.bool_or("_in").alias("grouped"))
    many = many.filter((F.col("lo") < F.col("hi")) & (F.col("top") == F.col("tile"))).select("token", "tile", "size", "grouped")
    out = written(d.drop("_in").join(many, ["token", "tile"]), "op8-todo")
    drop_written(d)
    return out


def star(rows: DataFrame) -> DataFrame:
    """Pairs of every set (b1) with two leaders (a1) of its band among the sets of a token.

    Eight ways to draw leaders are dealt to the tokens, so a group of near
    copies meets many leaders while the tokens that repeat it give equal pairs.
    This only saves work: what it leaves open, the later steps compare.
    """
    d = rows.withColumn("_r", F.xxhash64("k1", F.col("token").bitwiseAND(F.lit(7))))
    lead = d.groupBy("token", "band").agg(F.min_by("k1", "_r").alias("p"), F.max_by("k1", "_r").alias("q")).filter("p <> q")
    d = rows.join(written(lead, "op8-leaders"), ["token", "band"])
    d = d.select(F.explode(F.array("p", "q")).alias("a1"), F.col("k1").alias("b1")).filter("a1 <> b1").distinct()
    return d


def compare(group: list[tuple], best: bool) -> list[tuple]:
    """Pairs of a tile's rows (tile, band, own block, other block's rows apart, n, lab, k1, bits) that the bound allows.

    With best, of each two components only the pair with the greatest bound.
    """
    if len(group) < 2:
        return []
    group = sorted(group, key=lambda r: r[4])
    tile, band, own, apart, n, lab, k1, bits = zip(*group, strict=True)
    to = min(map(len, bits))
    flat = [b if len(b) == to else fold_bits(int.from_bytes(b, "little"), len(b), to).to_bytes(to, "little") for b in bits]
    m = np.frombuffer(b"".join(flat), dtype=np.uint64).reshape(len(group), -1)
    n, lab, own = np.array(n), np.array(lab), np.array(own)
    home = np.array(tile) == np.array(band)
    first = np.searchsorted(n * DEN, NUM * n)
    top: dict[tuple[int, int], tuple[int, tuple]] = {}
    found = []
    for y in range(1, len(group)):
        at = slice(first[y], y)
        ok = (lab[at] != lab[y]) & (home[at] | home[y])
        if apart[0]:
            ok &= own[at] != own[y]
        at = np.flatnonzero(ok) + first[y]
        if not len(at):
            continue
        over = (n[at] + n[y] - np.bitwise_count(m[at] ^ m[y]).sum(axis=1, dtype=np.int64)) // 2
        ok = DEN * over >= NUM * (n[at] + n[y] - over)
        for x, o in zip(at[ok].tolist(), over[ok].tolist(), strict=True):
            pair = (min(k1[x], k1[y]), max(k1[x], k1[y]))
            if not best:
                found.append(pair)
            elif o > top.get(key := (min(lab[x], lab[y]), max(lab[x], lab[y])), (-1, ()))[0]:
                top[key] = (o, pair)
    return [p for _, p in top.values()] if best else found


def residual(tiles: DataFrame, sets: DataFrame, best: bool, block: int = 2048) -> DataFrame:
    """Pairs of sets in different components that share a tile and that the bitmaps allow; large tiles are cut into blocks.

    Tiles with members of a component carry fine bitmaps, as most of their
    pairs are close; the others carry coarse ones.
    """
    blocks = F.ceil(F.col("size") / block)
    d = tiles.withColumn("own", F.pmod(F.xxhash64("k1"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    d = d.join(sets.select("k1", "n", "coarse", "fine"), "k1").withColumn("bits", F.when(F.col("grouped"), F.col("fine")).otherwise(F.col("coarse")))
    cols = ["token", "tile", "i", "j", "own", "band", "n", "lab", "k1", "bits"]
    d = d.select(*cols).repartition("token", "tile", "i", "j").sortWithinPartitions("token", "tile", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = [(c, pa.int64()) for c in PAIR]
        seen: set[tuple] = set()  # a pair meets in many tiles
        out: list[tuple] = []
        key, group = None, []

        def close() -> None:
            for p in compare(group, best):
                if p not in seen:
                    out.append(p)
                    if len(seen) < 1 << 20:
                        seen.add(p)

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in cols], strict=True):
                if r[:4] != key:
                    close()
                    key, group = r[:4], []
                group.append((r[1], r[5], r[4], r[2] != r[3], *r[6:]))
            if len(out) > 10_000:
                yield _batch(out, spec)
                out.clear()
        close()
        if out:
            yield _batch(out, spec)

    return d.mapInArrow(lean(run), "a1 long, b1 long").distinct()


# -- components ----------------------------------------------------------------


def joined(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, t (hash of the text), n, component (its smallest doc_id) and node (its key) of every row of docs; a null doc_id is NONE.

    Leaders merge most of a group of near copies, the closest pairs of two
    components most of the rest; then all pairs of sets that still share a tile
    and no component are compared.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, k)


def _joined(docs: DataFrame, k: int) -> DataFrame:
    for seed in range(0, 16, 2):
        sig = written(signatures(docs, k, seed), "op8-signatures")
        rows = sig.filter("n >= 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NONE)))
        both = rows.filter("n > 0").groupBy("k1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"), F.min("k2").alias("lo"), F.max("k2").alias("hi"))
        both = written(both, "op8-keys")
        if not both.filter("lo <> hi").head(1):  # two sets with one key: hash them otherwise
            break
        drop_written(both, sig)
    else:
        raise RuntimeError("sets share 64-bit keys under every seed")
    reps = both.select("k1", "rep")
    levels = shared_levels(summed(sig.filter("n = -1")))
    total = rows.agg(F.sum(F.least(F.col("n"), F.col("n") * (1 - NUM / DEN + 1 / 24) + 2))).head()[0] or 0
    packed = packed_prefixes(docs, levels, max(8, int(total) >> 18), k, seed)
    found = written(shared_tokens(packed), "op8-shared")
    tiles = distinct_tiles(found)
    drop_written(found)
    some = written(reps.join(tiles.select("k1").distinct(), "k1", "left_semi"), "op8-candidates")
    sets = written(of_sets(docs, some, k, seed, "coarse fine").join(some, "k1"), "op8-sets")

    edges, lab = None, None
    for step in ("star", "best", "all"):
        if step == "star":
            pairs = star(tiles)
        else:
            todo = open_tiles(tiles, lab)
            pairs = residual(todo.filter("grouped") if step == "best" else todo, sets, step == "best")
        close = written(bounded(pairs, sets, step == "star"), "op8-close")
        if close.head(1):
            found = verified(close, some, docs, k, seed)
            edges = found if edges is None else edges.union(found)
            old, lab = lab, labels(edges, some, lab)
            if old is not None:
                drop_written(old)
        drop_written(close)
        if step != "star":
            drop_written(todo)
    drop_written(tiles, some, sets)
    # Sets without links still join their equal copies.
    own = both.filter("c > 1").select("k1", F.struct(F.col("rep").alias("d"), F.col("k1").alias("k")).alias("lab"))
    if lab is not None:
        own = own.join(lab.select("k1", F.col("lab").alias("_l")), "k1", "full").select("k1", F.coalesce("_l", "lab").alias("lab"))
    own = written(own.select("k1", F.col("lab.d").alias("d"), F.col("lab.k").alias("k")), "op8-components")
    drop_written(both, *([lab] if lab is not None else []))
    out = rows.filter("n >= 0").join(own, "k1", "left")
    some = (F.col("n") > 0) & F.col("k").isNotNull()
    return out.select("doc_id", "t", "n", F.when(some, F.col("d")).otherwise(F.col("doc_id")).alias("component"), F.when(some, F.col("k")).otherwise(F.col("k1")).alias("node"))


def components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    real = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return joined(docs, k).select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id, of equal ids that of the smallest hash of its text.

    Rows without words stay, each for itself; of rows that share both doc_id and text one stays.
    """
    cell = ["doc_id", "t"]
    with cleared() as keep:
        got = written(joined(docs).filter("n > 0"), "op8-verdict")
        best = got.groupBy("node").agg(F.min("doc_id").alias("_d"), F.min_by("t", F.struct(*cell)).alias("_t"))
        gone = keep(written(got.join(best, "node").filter("doc_id <> _d or t <> _t").select(*cell).distinct(), "op8-gone"))
        twice = keep(written(got.groupBy(*cell).agg(F.count("*").alias("c")).filter("c > 1").select(*cell), "op8-twice"))
    return without(docs, [F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), F.xxhash64("text")], gone, twice)
