"""Packing tokenised documents into sequences by bin completion.

Documents become pieces of at most `capacity` tokens; only longer documents are
cut.  The search works on the histogram of piece lengths, which has `capacity`
rows however many documents there are: around the largest piece left it
enumerates the fillings of the gap that no piece left out dominates, prunes
those that waste more than a better packing may, and repeats a filling as often
as its lengths last.  Best-fit solutions are the incumbents; where they miss the
lower bound, branch and bound over fillings and their repeats looks for a better
packing, with the same number of steps at every size of input.

Pieces then take their places by their rank among those of their length, which
DataFrame work finds; the pattern table is bounded by the histogram.

Cases: null text counts as empty and is one piece of one token; repeated rows
are rows of their own; pieces of one length rank by hash, ties by doc_id and
piece; a null doc_id stays null; very long texts are encoded whole, in one
worker's memory, and cut; other columns may have any names; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, texts, written

CAPACITY = 4096
END = 1


# -- tokens ------------------------------------------------------------------


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """Text -> little-endian uint32 ids of the word-end BPE in `path`, equal to tokenizers' encode().

    This vocabulary drops white space and merges within words, so ids are those
    of the words, one after the other.  Words are encoded once and remembered;
    plain ones by rank merges with a byte that stands for the end of a word,
    all others by the tokenizers library itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    end = "</w>"
    ranks = {}
    for word, i in vocab.items():
        tail = b"\xff" if word.endswith(end) and word != end else b""
        body = word[: -len(end)] if tail else word
        if all(c in byte_of for c in body):
            ranks[bytes(byte_of[c] for c in body) + tail] = i
    # The names of special tokens are no merges.
    for word in [t.content for t in whole.get_added_tokens_decoder().values()]:
        ranks.pop(word.encode(), None)
    piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
    split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def ids(word: bytes) -> list[int]:
        w = word.decode("utf-8", "replace")
        if "<|" in w or not plain(w):
            return whole.encode(w, add_special_tokens=False).ids
        w = w.lower()
        if w.isalpha():
            return piece(w.encode() + b"\xff")
        out: list[int] = []
        for p in split(w):
            out += piece(p.encode() + b"\xff")
        return out

    class Memo(dict):
        def __missing__(self, word: bytes) -> bytes:
            if len(self) > 1 << 20:  # bounds memory; words are then encoded anew
                self.clear()
            out = np.array(ids(word), dtype="<u4").tobytes()
            if len(word) <= 64:
                self[word] = out
            return out

    memo = Memo()

    def encode(text: bytes) -> bytes:
        return b"".join(map(memo.__getitem__, text.split()))

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        stop, step = np.array([end], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            at, no, start, length, crc = [], [], [], [], []
            for i, x in enumerate(texts(b)):
                ids = encode(x) + stop
                for k, j in enumerate(range(0, len(ids), step)):
                    part = ids[j : j + step]
                    at.append(i)
                    no.append(k)
                    start.append(j // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at)), pa.array(no, pa.int32())]
                    + [pa.array(c, pa.int64()) for c in (start, length, crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


# -- search ------------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, times) in descending order of length
Pattern = tuple[int, Filling]  # a filled bin and how often it is made


@functools.lru_cache(maxsize=4)
def _rounded(capacity: int, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For k = 1, 2, ...: what each length weighs, and what a bin holds, if lengths count in parts of 1 / (k + 1), rounded down, of which k fit.

    Lengths that are whole parts keep their share; these are Fekete and Schepers' dual feasible functions.
    """
    x, k = np.arange(capacity + 1, dtype=np.int64), np.arange(1, most, dtype=np.int64)[:, None]
    parts, rest = np.divmod(x * (k + 1), capacity)
    return np.where(rest == 0, x * k, parts * capacity), (k * capacity).ravel()


def lower_bound(counts: Sequence[int], capacity: int) -> int:
    """Bins that any packing needs: by volume, by pieces too large to share a bin (Martello and Toth's L2), or by rounded lengths."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    n[: len(counts)] = counts
    cum_n, cum_v = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    big, mid = cum_n[-1] - cum_n[capacity - k], cum_n[capacity - k] - cum_n[half]
    spare = mid * capacity - (cum_v[capacity - k] - cum_v[half])
    small = cum_v[half] - np.where(k > 0, cum_v[k - 1], 0)
    need = big + mid + np.maximum(0, -(-(small - spare) // capacity))
    weight, room = _rounded(capacity)
    return max(-(-int(cum_v[-1]) // capacity), int(need.max()), int((-(-(weight @ n) // room)).max()))


class Stock:
    """Piece counts by length; a bit mask of the lengths that are left answers 'largest length at most x'."""

    def __init__(self, counts: Sequence[int]):
        self.n = [int(c) for c in counts]
        self.mask = sum(1 << x for x, c in enumerate(self.n) if x and c)

    def at_most(self, x: int) -> int:
        """Largest length <= x that is left, 0 if none."""
        return max(0, (self.mask & ((2 << x) - 1)).bit_length() - 1) if x > 0 else 0

    def take(self, filling: Filling, times: int = 1) -> None:
        for x, k in filling:
            self.n[x] -= k * times
            self.mask = self.mask | 1 << x if self.n[x] else self.mask & ~(1 << x)


def dominated(stock: Stock, filling: Filling, room: int) -> bool:
    """Whether a piece left out could join the filling, or stand in for one or more of its pieces.

    A piece y stands in for pieces of sum s if s < y <= s + room, or if y = s and
    they are two or more: what is freed is then no harder to place than y.  Sums
    are bits of an integer, so all pieces and all choices are tried at once.
    """
    out = stock.mask
    for x, k in filling:
        if stock.n[x] == k:
            out &= ~(1 << x)
    if out & ((2 << room) - 1):
        return True
    one = more = 0  # sums of one piece, of several
    for x, k in filling:
        c = 1
        while k:
            c = min(c, k)
            more |= (more | one) << (c * x) | (1 << (c * x) if c > 1 else 0)
            one |= 1 << x if c == 1 else 0
            k, c = k - c, 2 * c
    wide, width = (one | more) << 1, 1
    while width < room:
        step = min(width, room - width)
        wide, width = wide | wide << step, width + step
    return bool((more | (wide if room else 0)) & out)


NODE = 20  # steps that a node counts for, beside those of its completions


class Budget:
    """Steps of search that are left; the same at every size of input."""

    def __init__(self, steps: int):
        self.left = steps


def completions(stock: Stock, gap: int, waste: int, budget: Budget, steps: int = 400) -> tuple[list[tuple[int, Filling]], bool]:
    """Undominated fillings of a gap that waste `waste` at most, least waste first, and whether the enumeration came to its end.

    A level of the search is a length with the number of its pieces, so bins of
    any number of pieces are some tens of levels deep.
    """
    found: list[tuple[int, Filling]] = []
    spent = min(steps, budget.left)
    begun = spent

    def go(room: int, top: int, chosen: Filling) -> bool:
        """False once the enumeration shall end."""
        nonlocal spent
        x = stock.at_most(min(room, top))
        if not x:
            if room <= waste and not dominated(stock, chosen, room):
                found.append((room, chosen))
            return room > 0 or len(chosen) > 1 or sum(k for _, k in chosen) > 1  # one piece that fills the gap dominates all
        while x:
            for k in range(min(stock.n[x], room // x), 0, -1):
                spent -= 1
                if spent < 0 or not go(room - k * x, x - 1, (*chosen, (x, k))):
                    return False
            x = stock.at_most(x - 1)
        return True

    go(gap, gap, ())
    budget.left -= begun - max(spent, 0)
    found.sort(key=lambda f: (f[0], [(-x, -k) for x, k in f[1]]))
    return found, spent >= 0


def greedy(stock: Stock, gap: int) -> Filling:
    """The largest piece that fits, again and again: best fit."""
    out: list[tuple[int, int]] = []
    x = stock.at_most(gap)
    while x:
        k = min(stock.n[x], gap // x)
        out.append((x, k))
        gap -= k * x
        x = stock.at_most(min(x - 1, gap))
    return tuple(out)


def whole_bin(big: int, add: Filling) -> Filling:
    """A bin's largest piece and what completes it."""
    return ((big, add[0][1] + 1), *add[1:]) if add and add[0][0] == big else ((big, 1), *add)


def repeats(stock: Stock, filling: Filling) -> int:
    return min(stock.n[x] // k for x, k in filling)


def _fill(counts: Sequence[int], capacity: int, choose: Callable[[Stock, int], Filling]) -> list[Pattern]:
    """The largest piece left with what `choose` adds, as often as it can be repeated, until nothing is left."""
    stock, out = Stock(counts), []
    while big := stock.at_most(capacity):
        stock.take(((big, 1),))
        add = choose(stock, capacity - big)
        stock.take(((big, -1),))
        filling = whole_bin(big, add)
        times = repeats(stock, filling)
        stock.take(filling, times)
        out.append((times, filling))
    return out


def best_fit(counts: Sequence[int], capacity: int) -> list[Pattern]:
    """The largest piece, then again and again the largest that still fits."""
    return _fill(counts, capacity, greedy)


def bins(patterns: Sequence[Pattern]) -> int:
    return sum(t for t, _ in patterns)


def pack(counts: Sequence[int], capacity: int = CAPACITY, steps: int = 300_000) -> list[Pattern]:
    """Patterns for a histogram (counts[length]); as few bins as the search finds, never more than best fit."""
    goal = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    if bins(best) > goal:
        free = Budget(1 << 60)  # one completion a pattern, and patterns are bounded by the lengths
        least = _fill(counts, capacity, lambda s, gap: next((f for _, f in completions(s, gap, gap, free)[0]), greedy(s, gap)))
        best = min(best, least, key=bins)
    if bins(best) > goal:
        best = branch(counts, capacity, goal, best, Budget(steps))
    return best


def branch(counts: Sequence[int], capacity: int, goal: int, best: list[Pattern], budget: Budget) -> list[Pattern]:
    """Depth-first over the completions of the largest piece and how often each is repeated.

    Pruned are completions that waste more than a better packing may, and states
    whose rest cannot be packed in fewer bins than the best packing leaves.  A
    completion that is repeated as often as it can be uses up a length, so a
    descent takes at most `capacity` nodes however many pieces there are.
    """
    stock, volume = Stock(counts), sum(i * c for i, c in enumerate(counts))
    made: list[Pattern] = []
    size, waste, least = 0, 0, bins(best)

    def options() -> Iterator[tuple[int, int, Filling]]:
        if size + lower_bound(stock.n, capacity) >= least:
            return
        big = stock.at_most(capacity)
        stock.take(((big, 1),))
        fillings, whole = completions(stock, capacity - big, (least - 1) * capacity - volume - waste, budget)
        if not fillings and not whole:
            add = greedy(stock, capacity - big)
            fillings = [(capacity - big - sum(x * k for x, k in add), add)]
        stock.take(((big, -1),))
        for lost, add in fillings:
            filling = whole_bin(big, add)
            times = repeats(stock, filling)
            while times:
                yield times, lost, filling
                times //= 2

    stack = [options()] if stock.mask else []
    while stack and budget.left > 0:
        step = next(stack[-1], None)
        if step:
            times, lost, filling = step
            if waste + times * lost > (least - 1) * capacity - volume:  # no better than the best one
                continue
            budget.left -= NODE
            stock.take(filling, times)
            made.append((times, filling))
            size, waste = size + times, waste + times * lost
            if stock.mask:
                stack.append(options())
                continue
            if size < least:
                best, least = made.copy(), size
                if least <= goal:
                    break
        else:
            stack.pop()
        if made:
            times, filling = made.pop()
            stock.take(filling, -times)
            size, waste = size - times, waste - times * (capacity - sum(x * k for x, k in filling))
    return best


def places(patterns: Sequence[Pattern]) -> np.ndarray:
    """Rows (length, lo, hi, first sequence, pieces a sequence, offset): ranks lo..hi-1 of a length go, so many to each, to consecutive sequences."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, filling in patterns:
        offset = 0
        for x, k in filling:
            lo = used.get(x, 0)
            rows.append((x, lo, lo + k * times, base, k, offset))
            used[x] = lo + k * times
            offset += x * k
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """pieces() with sequence_id and offset."""
    rows = written(
        pieces(docs, tokenizer, capacity, end).withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")), "op10-pieces"
    )
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").count().collect():  # `capacity` rows at most
        counts[r["length"]] = r["count"]
    table = places(pack(counts, capacity))
    ranked = running_total(rows, ["length"], "_h", ["doc_id", "piece", "start", "ids_crc32"], F.lit(1), "_rank", 64)
    stride = int(table[:, 2].max()) + 1 if len(table) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = table[:, 0] * stride + table[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            _, lo, _, base, each, offset = table[np.searchsorted(first, length * stride + rank, side="right") - 1].T
            bin_, within = np.divmod(rank - lo, each)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(base + bin_), pa.array(offset + within * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "_rank"]
    return ranked.select(*cols).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
