"""Text keys: normalised names, articles, aliases, titles, dates in words.

All builders take and return Columns, so they stay inside code generation.  The
accent table is derived from Unicode decompositions, not written out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Leading articles of Spanish and English names.
ARTICLES = ("el", "la", "los", "las", "un", "una", "unos", "unas", "the", "a", "an")


def _accents() -> tuple[str, str]:
    src, dst = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accents()


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks, precomposed or combining."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def display_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " "))


def primary_key(c: Column) -> Column:
    """Lower case without marks of punctuation; & reads as the word y, apostrophes vanish."""
    x = F.translate(display_name(c), "’‘`´“”«»–—", "''''\"\"\"\"--")
    x = F.lower(F.regexp_replace(x, "&", " y "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "'", ""), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def secondary_key(c: Column) -> Column:
    return fold_accents(primary_key(c))


def without_articles(key: Column, articles: Sequence[str] = ARTICLES) -> Column:
    """Leading articles dropped as long as a word is left."""
    return F.regexp_replace(key, rf"^(?:(?:{'|'.join(articles)}) )+(?=\S)", "")


def name_forms(c: Column) -> Column:
    """struct(display, primary, secondary, articleless, articleless_plain, compact, compact_plain, tokens); the plain ones have no accents."""
    p, s = primary_key(c), secondary_key(c)
    return F.struct(
        display_name(c).alias("display"),
        p.alias("primary"),
        s.alias("secondary"),
        without_articles(p).alias("articleless"),
        fold_accents(without_articles(p)).alias("articleless_plain"),
        F.replace(p, F.lit(" "), F.lit("")).alias("compact"),
        F.replace(s, F.lit(" "), F.lit("")).alias("compact_plain"),
        F.filter(F.split(p, " "), lambda t: t != "").alias("tokens"),
    )


def variants(c: Column) -> Column:
    """Predictable spellings of a name, distinct."""
    n = name_forms(c)
    return F.array_distinct(F.array(n["primary"], n["articleless"], n["compact"], n["secondary"], n["articleless_plain"], n["compact_plain"]))


@F.pandas_udf(StringType())
def unicode_key(s: pd.Series) -> pd.Series:
    """NFKC, lower case, marks removed: for scripts beyond the accent table.  Apply to distinct strings and join back."""

    def key(x: str | None) -> str | None:
        if x is None:
            return None
        y = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x).lower())
        return unicodedata.normalize("NFC", "".join(ch for ch in y if not unicodedata.combining(ch)))

    return s.map(key, na_action=None)


def year_of(c: Column, first: int = 1900, last: int = 2100) -> Column:
    """A four-digit year within bounds, else null."""
    y = F.when(F.trim(c).rlike("^[0-9]{4}$"), F.trim(c).cast("int"))
    return F.when(y.between(first, last), y)


def declared_alias(c: Column) -> Column:
    """struct(name, alias) of 'name aka alias' and the like; alias null if none is declared."""
    mark = r"(?i)^(.*?)\s*[,(]?\s*\b(?:a\.?k\.?a\.?|alias|conocid[oa] como|also known as)(?![a-z])[:\s]*(.+?)\)?$"
    found = c.rlike(mark)
    return F.struct(
        F.when(found, F.regexp_extract(c, mark, 1)).otherwise(c).alias("name"),
        F.when(found, F.regexp_extract(c, mark, 2)).alias("alias"),
    )


def deceased_mark(c: Column) -> Column:
    """struct(name, deceased): a cross or R.I.P. at the end is a mark, no part of the name."""
    mark = r"(?i)\s*(?:[†✝✟]|\(?\s*(?:r\.?i\.?p\.?|q\.?e\.?p\.?d\.?)\s*\)?)\s*$"
    return F.struct(F.regexp_replace(c, mark, "").alias("name"), c.rlike(mark).alias("deceased"))


def is_live_title(c: Column) -> Column:
    return F.lower(c).rlike(r"(?:^|[\s(\[-])(?:live|en vivo|en directo|unplugged|en concierto)(?:$|[\s)\],.:-])")


def is_b_side_title(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(?:b[\s-]?sides?|lados? b|caras? b)\b")


def genre_items(c: Column) -> Column:
    """A list of genre texts: strong separators split always, ' y ' and ' and ' only where no strong one is."""
    x = F.lower(display_name(c))
    strong = F.split(x, r"\s*[,;/|]\s*")
    weak = F.split(x, r"\s+(?:y|and|&)\s+")
    return F.filter(F.when(F.size(strong) > 1, strong).otherwise(weak), lambda t: t != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(secondary_key(c), r"[^a-z0-9]+", "-"), "^-|-$", "")


def excerpt(c: Column, most: int) -> Column:
    """At most `most` characters, to the end of a sentence if one ends in the second half, else to a word."""
    cut = F.substring(c, 1, most)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    short = F.length(c) <= most
    return F.when(short, c).when(F.length(sentence) >= most // 2, sentence).otherwise(F.concat(word, F.lit("…")))


# Numbers as they occur in titles, and words for volume, which all read as the last one.
NUMBER_WORDS = {
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "diez": "10", "once": "11", "doce": "12", "ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12",
}
VOLUME_WORDS = ("vol", "vols", "volume", "volumen")


def title_tokens(c: Column) -> Column:
    """Words of a title with numbers as digits and one word for volume; an i right after it is a 1."""
    numbers = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    words = F.filter(F.split(secondary_key(c), " "), lambda t: t != "")
    first = lambda t, i: (t == "i") & (i > 0) & F.get(words, i - 1).isin(*VOLUME_WORDS)
    return F.transform(words, lambda t, i: F.when(t.isin(*VOLUME_WORDS), VOLUME_WORDS[-1]).when(first(t, i), "1").otherwise(F.coalesce(numbers[t], t)))


def track_core(c: Column) -> Column:
    """struct(core, markers): the title before brackets, and what the brackets say."""
    inside = F.regexp_extract_all(c, F.lit(r"[\(\[]([^\)\]]*)[\)\]]"), F.lit(1))
    return F.struct(
        display_name(F.regexp_replace(c, r"[\(\[][^\)\]]*[\)\]]", " ")).alias("core"),
        F.transform(inside, lambda x: secondary_key(x)).alias("markers"),
    )


def clean_invisible(c: Column) -> Column:
    """Without zero-width and control characters; line ends and tabs stay."""
    return F.regexp_replace(c, r"[​-‏⁠﻿­\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def html_text(c: Column) -> Column:
    """The five predefined entities and numeric blanks as characters."""
    out = c
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


@F.pandas_udf(StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252, read rightly; other texts stay."""

    def fix(x: str | None) -> str | None:
        if x is None or not any(m in x for m in ("Ã", "Â", "â€")):
            return x
        try:
            return x.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return x

    return s.map(fix, na_action=None)
