"""Token counts by section: whole documents are encoded once and their tokens dealt to sections by character spans.

Sections are half-open character spans that cover the document in order (its
lines, each with its line end, unless another splitter is given).  Each token
has the span of the characters it touches; the interval join of the two span
lists gives the overlaps.  A token that crosses a border counts, as a whole,
for the section that holds most of its characters, on a tie for the earliest;
so the counts of a document's sections add up to its tokens.

Cases: null and empty texts have one section 0..0 without tokens; sections
without characters get no tokens; repeated rows are counted row by row; very
long texts are encoded whole, in one worker's memory; other columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts


def byte_bpe(path: str, pattern: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """Encoder to ids, and every id's length in bytes, of a ranks file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return (lambda text: np.asarray(enc.encode_ordinary(text), dtype=np.int64)), length


def line_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which lines begin; a line ends after its \\n."""
    b = np.frombuffer(text, dtype=np.uint8)
    cut = np.flatnonzero(b == 10) + 1
    return np.concatenate([[0], cut[cut < len(b)]])


def char_index(text: bytes) -> np.ndarray | None:
    """Number of characters that begin before each byte offset; None if all are ASCII."""
    if text.isascii():
        return None
    b = np.frombuffer(text, dtype=np.uint8)
    return np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])


def attribute(token_bytes: np.ndarray, starts: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section borders in characters, tokens by section, and of those the ones that cross a border."""
    end = np.cumsum(token_bytes)
    begin = end - token_bytes
    at = char_index(text)
    border = np.append(starts, len(text))
    if at is not None:
        # A token that begins or ends within a character touches that character.
        begin, end = at[begin + 1] - 1, at[end]
        border = at[border]
    n = len(starts)
    first = np.searchsorted(border[:-1], begin, side="right") - 1
    last = np.searchsorted(border[:-1], end - 1, side="right") - 1
    own = first.copy()
    cross = np.flatnonzero(first != last)
    for t in cross:
        best = -1
        for s in range(first[t], last[t] + 1):
            over = min(end[t], border[s + 1]) - max(begin[t], border[s])
            if over > best:
                best, own[t] = over, s
    return border, np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n)


def section_tokens(
    docs: DataFrame, ranks: str, pattern: str, starts: Callable[[bytes], np.ndarray] = line_starts
) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing (of them across a border), doc_tokens."""
    names = ["section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, length = byte_bpe(ranks, pattern)
        for b in batches:
            if not b.num_rows:
                continue
            at, cols = [], []
            for i, x in enumerate(texts(b)):
                if x:
                    border, n, crossing = attribute(length[encode(x.decode("utf-8", "replace"))], starts(x), x)
                else:
                    border, n, crossing = np.zeros(2, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
                k = len(n)
                at.append(np.full(k, i))
                cols.append((np.arange(k), border[:-1], border[1:], n, crossing, np.full(k, n.sum())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(np.concatenate(at)))]
                + [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*cols, strict=True)],
                ["doc_id", *names],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def field_tokens(docs: DataFrame, fields: list[str], ranks: str, pattern: str) -> DataFrame:
    """Tokens by field of records rendered as their fields, one a line; field i is section i.

    Line ends within a field count as blanks, so that fields and lines agree.
    """
    flat = [F.translate(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "\n", " ") for c in fields]
    whole = docs.select("doc_id", F.concat_ws("\n", *flat, F.lit(" ")).alias("text"))
    return section_tokens(whole, ranks, pattern).filter(F.col("section") < len(fields))
