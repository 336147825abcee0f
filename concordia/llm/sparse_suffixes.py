"""Passages that repeat across documents, by a sparse suffix array at minimiser positions.

A suffix is retained where the hash of its first BLOCK words is the least among
the blocks of a window of MIN_WORDS words, so every passage of MIN_WORDS words
retains the same suffix wherever it stands.  The retained suffixes are sorted
by their first block and neighbours compared across partition borders; those
with an equal neighbour in another document are matches.  Matches are extended
left and right: each owns the windows of MIN_WORDS words for which it is the
minimiser.  Matches whose whole surroundings agree extend at once; the rest is
compared window by window, so no passage is lost to a neighbour that agrees on
one side only.  Overlapping windows join into maximal spans.

Cases: null, empty and shorter texts have no spans; words are compared exactly;
a passage that repeats within one document only is not reported; rows that
share a doc_id count as one document; of equal hashes in a window the leftmost is
retained; doc_id is of an integer type; very long texts are read whole, in one
worker's memory; other columns may have any names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_bits, bloom_has, bloom_size, drop_written, gram_hashes, mix64, sent, texts, word_slabs, written

MIN_WORDS, BLOCK = 50, 25
NONE = -(1 << 63)  # stands for a null doc_id


def minimisers(blocks: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` blocks the position of its least hash, the leftmost of equals."""
    # Sliding minimum by doubling: best[i] is the place of the least of blocks[i : i + size].
    n = len(blocks) - width + 1
    place, size = np.arange(len(blocks)), 1
    while size < width:
        step = min(size, width - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(blocks[b] < blocks[a], b, a)
        size += step
    return place[:n]


def suffix_positions(parts: Sequence[bytes], words: int = MIN_WORDS, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text word hashes, block hashes and, by window of `words` words, the position of the retained suffix."""
    for _, every, begin in word_slabs(parts):
        blocks = gram_hashes(every, block) if len(every) >= block else every[:0]
        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if e - s < words:
                yield every[s:e], blocks[:0], np.zeros(0, dtype=np.int64)
            else:
                g = blocks[s : e - block + 1]
                yield every[s:e], g, minimisers(g, words - block + 1)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return np.array([NONE if x is None else int(x) for x in b.column("doc_id").to_pylist()], dtype=np.int64)


def retained(docs: DataFrame, words: int, block: int) -> DataFrame:
    """suffix (hash of its first block), doc_id, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d, p = [], [], []
            for i, (_, g, m) in zip(_ids(b), suffix_positions(texts(b), words, block), strict=True):
                if len(m):
                    at = m[np.concatenate([[True], m[1:] != m[:-1]])]
                    h.append(g[at])
                    d.append(np.full(len(at), i))
                    p.append(at)
            if h:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(d)), pa.array(np.concatenate(p).astype(np.int32))],
                    ["suffix", "doc_id", "pos"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "suffix long, doc_id long, pos int")


def matched(suffixes: DataFrame) -> DataFrame:
    """Suffix hashes with an equal neighbour in another document.

    The sort is by suffix, then document, over range partitions, so a suffix
    that very many documents share spans several partitions.  Each streams
    through its runs; a run that touches a border of its partition is kept
    without a look, which the extension makes good.
    """
    ordered = suffixes.repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # suffix and first document of the open run
        kept, first = False, True
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("suffix").to_numpy(zero_copy_only=False)
            d = b.column("doc_id").to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or h[0] != last[0]], h[1:] != h[:-1]])
            # A neighbour of the same suffix and another document.
            other = np.concatenate([[not new[0] and d[0] != last[1]], ~new[1:] & (d[1:] != d[:-1])])
            run_id = np.cumsum(new)
            hit = set(run_id[other].tolist())
            if 0 in hit:
                hit.discard(0)
                if not kept:
                    kept = True
                    yield _suffixes([last[0]])
            out = [int(h[i]) for i in np.flatnonzero(new) if run_id[i] in hit or first and i == 0]
            if first and out[:1] == [int(h[0])]:
                hit.add(1)
            first = False
            if out:
                yield _suffixes(out)
            if new.any():
                kept = int(run_id[-1]) in hit
            last = (int(h[-1]), int(d[-1]))
        if last is not None and not kept:
            yield _suffixes([last[0]])

    return ordered.select("suffix", "doc_id").mapInArrow(run, "suffix long").distinct()


def _suffixes(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], ["suffix"])


def surroundings(docs: DataFrame, bits: np.ndarray, log2_bits: int, words: int, block: int) -> DataFrame:
    """suffix, whole (hash of all windows the suffix owns), doc_id, first (window), windows (their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            h, whole, d, first, own = [], [], [], [], []
            for i, (w, g, m) in zip(_ids(b), suffix_positions(texts(b), words, block), strict=True):
                if not len(m):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                end = np.append(begin[1:], len(m))
                hit = bloom_has(bits, g[m[begin]], log2_bits)
                if not hit.any():
                    continue
                # A window is its two halves and, if they do not meet, its last block.
                far = g[words - block :][: len(m)]
                win = mix64(g[: len(m)] * np.uint64(0x9E3779B97F4A7C15) + far)
                if 2 * block < words:
                    win = gram_hashes(w, words)
                for s, e in zip(begin[hit], end[hit], strict=True):
                    part = win[s:e].tobytes()
                    h.append(int(g[m[s]]))
                    whole.append(xxh64_intdigest(part, int(m[s] - s)))
                    d.append(i)
                    first.append(s)
                    own.append(part)
            if h:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (h, whole)]
                    + [pa.array(d, pa.int64()), pa.array(first, pa.int32()), pa.array(own, pa.binary())],
                    ["suffix", "whole", "doc_id", "first", "windows"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "suffix long, whole long, doc_id long, first int, windows binary"
    )


def windows_of(rows: DataFrame) -> DataFrame:
    """window, doc_id, at for every window of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("windows").to_pylist()
            n = np.array([len(x) // 8 for x in own], dtype=np.int64)
            if not n.sum():
                continue
            start = np.repeat(b.column("first").to_numpy(zero_copy_only=False), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(own), dtype=np.int64)),
                    pa.array(np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), n)),
                    pa.array((start + step).astype(np.int32)),
                ],
                ["window", "doc_id", "at"],
            )

    return rows.select("windows", "first", "doc_id").mapInArrow(run, "window long, doc_id long, at int")


def repeated_spans(docs: DataFrame, words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, other_id (smallest other document that shares a part)."""
    suffixes = written(retained(docs, words, block), "op6-suffixes")
    found = written(matched(suffixes), "op6-matched")
    drop_written(suffixes)
    log2_bits = bloom_size(found.count())
    bits = bloom_bits(found, F.col("suffix"), log2_bits)
    drop_written(found)
    around = written(surroundings(docs, bits, log2_bits, words, block), "op6-surroundings")
    group = around.groupBy("suffix", "whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("first", "doc_id").alias("_f"), F.max_by("first", "doc_id").alias("_g"))
    group = written(group, "op6-groups")
    # Suffixes with more than one surrounding are compared window by window.
    mixed = group.groupBy("suffix").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.min("lo").alias("c"), F.max("hi").alias("d"))
    mixed = written(mixed.filter((F.col("a") < F.col("b")) & (F.col("c") < F.col("d"))).select("suffix"), "op6-mixed")
    mixed = sent(mixed)  # a suffix that very many rows share then stays where its rows are
    both = around.join(group, ["suffix", "whole"])
    n = (F.length("windows") / 8).cast("int")
    other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    at_once = both.filter("lo < hi").select("doc_id", F.col("first").alias("s"), (F.col("first") + n - 1 + words).alias("e"), other.alias("o"))
    alone = both.filter("lo = hi").join(mixed, "suffix", "left_semi")
    # Two stand-ins of different documents for each shared surrounding, so that any row meets another
    # document; all rows of those in one document.
    stand = both.filter("lo < hi").join(mixed, "suffix", "left_semi").filter("doc_id = lo and first = _f or doc_id = hi and first = _g")
    wins = written(windows_of(alone.select("windows", "first", "doc_id").union(stand.select("windows", "first", "doc_id"))), "op6-windows")
    drop = wins.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    by_window = wins.join(drop, "window").select("doc_id", F.col("at").alias("s"), (F.col("at") + words).alias("e"), other.alias("o"))
    parts = at_once.union(by_window)
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", (F.col("s") > F.coalesce(reach, F.lit(-1))).cast("int"))
    parts = parts.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("doc_id", "_span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("o").alias("other_id"))
    real = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return spans.select(
        real("doc_id"), F.col("start_word").cast("long"), F.col("end_word").cast("long"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), real("other_id"),
    )
