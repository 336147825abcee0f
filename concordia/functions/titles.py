"""Titles and names as identities: generic titles, relations of titles, recordings, bands, parts of a series, roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import similarity as S
from . import text as T
from .similarity import _jaro_winkler, _osa

# Words that alone identify no album, articles, and brackets that name another recording.
GENERIC_WORDS = ("demo", "demos", "ep", "eps", "single", "sencillo", "maqueta", "maquetas", "bootleg", "promo", "sampler", "lp", "en", "vivo", "live", "directo", "casero", "volumen", "de", "el", "la", "los", "las")
TITLE_ARTICLES = ("el", "la", "los", "las", "the", "a", "an", "un", "una")
OTHER_RECORDING = r"\b(?:remix|mix|live|en vivo|vivo|directo|acustic[oa]|acoustic|unplugged|instrumental|demo|maqueta|reprise|v[0-9]+|version extendida|extended|remaster\w*)\b"

# Ordinals in names of bands, by digit, and what wraps a band's name.
ORDINALS = {
    "1": r"1(?:ra|era|ro|ero|a|o|er)?|primer[ao]?|uno|una",
    "2": r"2(?:da|do|a|o)?|segund[ao]|dos",
    "3": r"3(?:ra|ro|era|ero|a|o|er)?|tercer[ao]?|tres",
    "4": r"4(?:ta|to|a|o)?|cuart[ao]|cuatro",
    "5": r"5(?:ta|to|a|o)?|quint[ao]|cinco",
    "6": "seis|sexto|sexta",
    "7": "siete|septim[ao]|setim[ao]",
    "8": "ocho|octav[ao]",
    "9": "nueve|noven[ao]",
    "10": "diez|decim[ao]",
}
WRAPPERS = (
    "^(?:la |el )?(?:banda|grupo|orquesta|conjunto|combo|ensamble) (?:de |del )?",
    " (?:y|&) (?:su|sus) (?:banda|grupo|orquesta|conjunto|combo)$",
    " (?:la banda|band|banda|y la banda)$",
)

# Words for parts of a series by kind, and the numbers that stand beside them.
PART_KINDS = {"side": ("lado", "side", "cara"), "disc": ("cd", "disco", "disc", "disk"), "part": ("parte", "part"), "volume": ("vol", "volumen", "volume", "volúmen")}
PART_NUMBERS = {"a": 1, "b": 2, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "one": 1, "two": 2, "three": 3}


def _bare(joined: Column) -> Column:
    return T.without_articles(joined, TITLE_ARTICLES)


def _tells(words: Column) -> Column:
    """The words that are neither generic nor numbers."""
    return F.filter(words, lambda w: ~w.isin(*GENERIC_WORDS) & ~w.rlike("^[0-9]+$"))


def is_generic(title: Column, owner: Column) -> Column:
    """Whether a title identifies nothing: generic words and numbers only, no words, or the owner's name."""
    a, b = T.title_tokens(title), F.array_join(T.title_tokens(owner), " ")
    joined = F.array_join(a, " ")
    return (F.size(_tells(a)) == 0) | (joined == b) | (_bare(joined) == _bare(b))


def title_forms(title: Column, owner: Column) -> Column:
    """Spellings of a title as words joined by blanks: with and without articles and the owner's name before it."""
    x, who = F.array_join(T.title_tokens(title), " "), F.array_join(T.title_tokens(owner), " ")
    after = lambda p: F.when((p != "") & F.startswith(x, F.concat(p, F.lit(" "))), F.substr(x, F.length(p) + 2))
    return F.filter(F.array_distinct(F.array_compact(F.array(x, _bare(x), after(who), after(_bare(who))))), lambda v: v != "")


def _close(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    if n < 6:
        return False
    if n >= 8 and _jaro_winkler(a, b) >= 0.9:
        return True
    return abs(len(a) - len(b)) <= 2 and _osa(a, b) <= (2 if n >= 8 else 1)


@F.pandas_udf(BooleanType())
def any_close(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two lists hold two keys that differ by typos only."""
    return pd.Series([x is not None and y is not None and any(_close(p, q) for p in x for q in y) for x, y in zip(a, b, strict=True)], dtype="boolean")


def title_relation(left: Column, right: Column, owner: Column) -> Column:
    """equal, generic, contains, fuzzy or unrelated: the best over the spellings of two titles of one owner."""
    solid = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    a, b = title_forms(left, owner), title_forms(right, owner)

    def inside(x: Column, y: Column) -> Column:
        words, other = F.split(x, " "), F.split(y, " ")
        shorter = F.length(solid(x)) <= F.length(solid(y))
        whole = (F.length(solid(x)) >= 4) & F.contains(solid(y), solid(x))
        return shorter & (F.size(_tells(words)) > 0) & (whole | (F.size(words) >= 2) & (F.size(F.array_except(words, other)) == 0))

    contains = F.exists(a, lambda x: F.exists(b, lambda y: inside(x, y) | inside(y, x)))
    keys = lambda v: F.transform(v, solid)
    return (
        F.when(F.arrays_overlap(keys(a), keys(b)), "equal")
        .when(is_generic(left, owner) | is_generic(right, owner), "generic")
        .when(contains, "contains")
        .when(any_close(keys(a), keys(b)), "fuzzy")
        .otherwise("unrelated")
    )


def same_recording(left: Column, right: Column) -> Column:
    """Whether two track titles name one recording: typos by length, or one cut short; brackets such as (Remix) must agree."""
    solid = lambda c: F.replace(T.secondary_key(F.regexp_replace(c, r"[(\[{][^)\]}]*[)\]}]", " ")), F.lit(" "), F.lit(""))
    inner = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[(\[{]([^)\]}]*)[)\]}]"), F.lit(1)), T.secondary_key)
    marks = lambda c: F.array_sort(F.filter(inner(c), lambda x: x.rlike(OTHER_RECORDING)))
    a, b = solid(left), solid(right)
    n = F.least(F.length(a), F.length(b))
    typos = S.osa_distance(a, b) <= F.when(n >= 10, 2).when(n >= 5, 1).otherwise(0)
    cut = lambda short, long, raw: F.startswith(long, short) & ((F.length(short) >= 8) | raw.rlike(r"(?:[:…]|\.\.\.)\s*$"))
    start = F.when(F.length(a) <= F.length(b), cut(a, b, left)).otherwise(cut(b, a, right))
    return (a != "") & (b != "") & (marks(left) == marks(right)) & (typos | start)


def band_key(name: Column) -> Column:
    """A compact key with ordinals as digits and without what wraps a band's name."""
    key = T.secondary_key(F.regexp_replace(name, r"\s+[-–—]\s+", " "))
    out = key
    for digit, words in ORDINALS.items():
        out = F.regexp_replace(out, rf"\b(?:{words})\b", digit)
    for wrap in WRAPPERS:
        out = F.trim(F.regexp_replace(out, wrap, ""))
    return F.replace(F.when(out == "", key).otherwise(out), F.lit(" "), F.lit(""))


def album_part(title: Column) -> Column:
    """struct(base, word, kind, place) of a title that ends in, or has inside, a part of a series; null without one.

    'Live - Disco 2' is part 2 of 'Live'; 'Serie Vol. I, Ana' is volume 1 of
    'Serie, Ana'; formats ('DVD') and editions ('Deluxe Edition') have no place.
    """
    gap = r"[\s\-–—:,.]*[(\[]?\s*"
    words = "|".join(w for ws in PART_KINDS.values() for w in sorted(ws, key=len, reverse=True))
    number = rf"[0-9]{{1,2}}|[ivx]{{1,4}}|{'|'.join(w for w in PART_NUMBERS if len(w) == 1 and w in 'ab' or len(w) > 2 and not set(w) <= set('ivx'))}"
    ends = rf"(?iu)^(.*?\S){gap}(?<![\p{{L}}])({words})\.?\s*({number})(?:\s*(?:/|de|of)\s*[0-9]{{1,2}})?\s*[)\]]?\s*$"
    edition = rf"(?iu)^(.*?\S){gap}((?:(?:cd|lp|vinyl|vinilo)\s+)?(?:reissue|re-?edici[oó]n|remaster(?:ed|izado)?)|cassette|casete|(?:super\s+)?deluxe(?:\s+\p{{L}}+)?\s+edition|edici[oó]n\s+(?:especial|de\s+lujo|aniversario))\s*[)\]]?\s*$"
    middle = r"(?iu)^(.*?\S)[\s\-–—:,.]*\b(vol(?:umen|ume)?)\.?\s*([0-9]{1,2}|[ivx]{1,4})\b([\s\-–—:,.]+)(\S.*)$"
    form = rf"(?iu)^(.*?\S){gap}(cd\s*/\s*dvd|dvd\s*/\s*cd|dvd|cd|lp)\s*[)\]]?\s*$"
    t = F.trim(title)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s\-–—:,.(\[]+$", ""), r"\s*\((?:19|20)[0-9]{2}\)$", ""))
    kinds = F.create_map(*[F.lit(x) for k, ws in PART_KINDS.items() for w in ws for x in (w, k)])
    places = F.create_map(*[F.lit(x) for kv in PART_NUMBERS.items() for x in kv])
    place = lambda c: F.coalesce(F.when(c.rlike("^[0-9]+$"), c).cast("int"), places[F.lower(c)])
    got = lambda p, i: F.regexp_extract(t, p, i)
    joint = F.when(F.contains(got(middle, 4), F.lit(",")), ", ").when(got(middle, 4).rlike("[-–—]"), " - ").otherwise(" ")

    def part(base: Column, word: Column, kind: Column, at: Column) -> Column:
        return F.struct(base.alias("base"), F.lower(word).alias("word"), kind.alias("kind"), at.alias("place"))

    none = F.lit(None).cast("int")
    numbered = t.rlike(ends) & place(got(ends, 3)).isNotNull() & (clean(got(ends, 1)) != "")
    return (
        F.when(numbered, part(clean(got(ends, 1)), got(ends, 2), kinds[F.lower(got(ends, 2))], place(got(ends, 3))))
        .when(t.rlike(edition) & (clean(got(edition, 1)) != ""), part(clean(got(edition, 1)), got(edition, 2), F.lit("edition"), none))
        .when(
            t.rlike(middle) & place(got(middle, 3)).isNotNull() & (clean(got(middle, 1)) != ""),
            part(F.concat(clean(got(middle, 1)), joint, F.trim(got(middle, 5))), got(middle, 2), F.lit("volume"), place(got(middle, 3))),
        )
        .when(t.rlike(form) & (clean(got(form, 1)) != ""), part(clean(got(form, 1)), F.regexp_replace(got(form, 2), r"\s", ""), F.lit("format"), none))
    )


def role_keys(role: Column, words: Mapping[str, str], generic: Sequence[str] = ()) -> Column:
    """Distinct keys of the pieces of a role: canonical words in order.

    Pieces part at commas, slashes, ampersands and the word 'and' outside
    brackets.  words: canonical word by word, '' for one that says nothing.
    """
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else None
    pieces = F.split(role, r"(?i)(?:[,&/;]| y | and )(?![^()]*\))")

    def key(piece: Column) -> Column:
        x = F.lower(T.fold_accents(piece))
        x = F.regexp_replace(F.regexp_replace(x, r"\([^)]*[0-9][^)]*\)", " "), "[^a-z0-9/?]+", " ")
        tokens = F.filter(F.split(F.trim(x), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        single = lambda w: F.when((F.length(w) > 4) & w.rlike("[^s]s$"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        tokens = F.transform(tokens, lambda w: F.coalesce(known[w], single(w)) if known is not None else single(w))
        out = F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda w: w != ""))), " ")
        return F.when(F.trim(x).isin(list(generic)), "").otherwise(out) if generic else out

    return F.array_distinct(F.filter(F.transform(pieces, key), lambda k: k != ""))


def same_role(a: Column, b: Column) -> Column:
    """Whether each key of two role_keys arrays is covered by one of the other, which may be more concrete."""
    covered = lambda xs, ys: F.forall(xs, lambda x: F.exists(ys, lambda y: F.size(F.array_except(F.split(x, " "), F.split(y, " "))) == 0))
    return covered(a, b) & covered(b, a)


def phrase_intent(query: Column, intents: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first intent, in the order given, with a phrase that a query holds as whole words; words may be in the plural."""
    words = F.trim(F.regexp_replace(F.lower(T.fold_accents(query)), "[^a-z0-9]+", " "))
    padded, tokens = F.concat(F.lit(" "), words, F.lit(" ")), F.split(words, " ")
    singular = F.transform(F.filter(tokens, lambda w: (F.length(w) > 3) & F.endswith(w, F.lit("s"))), lambda w: F.substr(w, F.lit(1), F.length(w) - 1))
    heard = F.concat(tokens, singular)
    out = F.lit(None).cast("string")
    for name, phrases in reversed(intents):
        long = [F.contains(padded, F.lit(f" {p} ")) for p in phrases if " " in p]
        short = [F.arrays_overlap(heard, F.array(*[F.lit(p) for p in phrases if " " not in p]))] if any(" " not in p for p in phrases) else []
        hit = F.lit(False)
        for c in long + short:
            hit = hit | c
        out = F.when(hit, name).otherwise(out)
    return F.when(words != "", out)
