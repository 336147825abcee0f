"""String and set similarity."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


# Words of names that say nothing about identity.
SMALL_WORDS = ("de", "del", "la", "el", "los", "las", "y", "e", "the", "and", "&", "a", "of")


def grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of a key, padded with two blanks before and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n))))


def dice(a: Column, b: Column) -> Column:
    """2 |A & B| / (|A| + |B|) of two sets as arrays."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    """|A & B| / |A | B|; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def edit_within(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, -1 above `most`."""
    return F.levenshtein(a, b, most)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    common = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                common.append(ch)
                break
    m = len(common)
    if not m:
        return 0.0
    other = [ch for j, ch in enumerate(b) if not free[j]]
    swaps = sum(x != y for x, y in zip(common, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return round(jaro + lead * 0.1 * (1 - jaro), 5)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler with prefix weight 0.1 up to four letters, without a threshold for it, to five places."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _osa(a: str, b: str) -> int:
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits with transposition of neighbours, each place edited once."""
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def ranges_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two year ranges touch; an end that is not known is the other end, and a range without ends gives null."""
    return (F.coalesce(a_from, a_to) <= F.coalesce(b_to, b_from)) & (F.coalesce(b_from, b_to) <= F.coalesce(a_to, a_from))


def nearness(a: Column, b: Column, least_tokens: int = 1, small: Sequence[str] = SMALL_WORDS) -> Column:
    """exact, reordered, contained or typo, else null, of two folded keys.

    Small words do not count.  Contained: all words of a name of least_tokens or
    more are among those of one with more words.  Typos are edits of the names
    without blanks: one from six letters on, two from twelve.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(list(small)))
    ta, tb = words(a), words(b)
    inside = lambda x, y: (F.size(x) >= least_tokens) & (F.size(x) < F.size(y)) & (F.size(F.array_except(x, y)) == 0)
    ca, cb = F.array_join(ta, ""), F.array_join(tb, "")
    n = F.least(F.length(ca), F.length(cb))
    most = F.when(n >= 12, 2).when(n >= 6, 1).otherwise(0)
    return (
        F.when((a == b) | (F.size(ta) > 0) & (ta == tb), "exact")
        .when((F.size(ta) > 1) & (F.array_sort(ta) == F.array_sort(tb)), "reordered")
        .when(inside(ta, tb) | inside(tb, ta), "contained")
        .when((most > 0) & (F.levenshtein(ca, cb) <= most), "typo")
    )


def numbers_differ(a: Column, b: Column) -> Column:
    """Whether two titles both name numbers, and not the same ones; 02 is 2."""
    nums = lambda c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))
    return (F.size(nums(a)) > 0) & (F.size(nums(b)) > 0) & (nums(a) != nums(b))
