"""Golden cases of the column builders."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordia.functions import dates as D
from concordia.functions import similarity as S
from concordia.functions import text as T


def one(spark, **cols):
    """Values of column expressions over one row."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict(recursive=True)


def test_accents_share_the_secondary_key(spark):
    r = one(spark, a=T.name_forms(F.lit("Canción")), b=T.name_forms(F.lit("Canción")))
    assert r["a"]["secondary"] == r["b"]["secondary"] == "cancion"
    assert r["a"]["primary"] != r["a"]["secondary"]


def test_punctuation_and_articles(spark):
    r = one(spark, a=T.name_forms(F.lit("Los D’León — Rock")), b=T.name_forms(F.lit("los d'león rock")), c=T.name_forms(F.lit("La La")), d=T.name_forms(F.lit("Guns & Roses")))
    assert r["a"]["primary"] == r["b"]["primary"] == "los dleón rock"
    assert r["a"]["articleless"] == "dleón rock" and r["a"]["compact"] == "losdleónrock" and r["a"]["articleless_plain"] == "dleon rock"
    assert r["c"]["articleless"] == "la"
    assert r["d"]["primary"] == "guns y roses"


def test_names_with_marks(spark):
    r = one(spark, a=T.declared_alias(F.lit("Simón Díaz (aka El Tío)")), b=T.declared_alias(F.lit("Simón Díaz")), c=T.deceased_mark(F.lit("Ana Pérez †")), d=T.year_of(F.lit("1899")), e=T.year_of(F.lit(" 1994 ")))
    assert r["a"] == {"name": "Simón Díaz", "alias": "El Tío"}
    assert r["b"] == {"name": "Simón Díaz", "alias": None}
    assert r["c"] == {"name": "Ana Pérez", "deceased": True}
    assert r["d"] is None and r["e"] == 1994


def test_titles(spark):
    r = one(spark, live=T.is_live_title(F.lit("Noche (en vivo)")), not_live=T.is_live_title(F.lit("Alive")), b=T.is_b_side_title(F.lit("Lados B")), tokens=T.title_tokens(F.lit("Grandes éxitos Vol. II")), core=T.track_core(F.lit("Luna (Remix) [Demo]")), items=T.genre_items(F.lit("Rock, Pop y Jazz")), weak=T.genre_items(F.lit("Rock y Pop")), slug=T.slug(F.lit("¡Año Nuevo!")))
    assert r["live"] and not r["not_live"] and r["b"]
    assert r["tokens"] == ["grandes", "exitos", "volumen", "2"]
    assert r["core"] == {"core": "Luna", "markers": ["remix", "demo"]}
    assert r["items"] == ["rock", "pop y jazz"] and r["weak"] == ["rock", "pop"]
    assert r["slug"] == "ano-nuevo"


def test_repairs(spark):
    r = one(spark, a=T.repair_mojibake(F.lit("CanciÃ³n")), b=T.repair_mojibake(F.lit("Ánimo")), c=T.clean_invisible(F.lit("a​b")), d=T.html_text(F.lit("R&amp;B &lt;3")), e=T.unicode_key(F.lit("ﬁ Ñ")), f=T.excerpt(F.lit("One two. Three four five six"), 12))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("Canción", "Ánimo", "ab", "R&B <3", "fi n")
    assert r["f"] == "One two."


def test_similarity(spark):
    f = lambda a, b: one(spark, x=S.jaro_winkler(F.lit(a), F.lit(b)))["x"]
    assert f("MARTHA", "MARHTA") == pytest.approx(0.96111)
    assert f("abcxyz", "abqqqq") == pytest.approx(0.64444)
    assert f("", "a") == 0 and f("a", "a") == 1
    r = one(spark, o=S.osa_distance(F.lit("ab"), F.lit("ba")), k=F.levenshtein(F.lit("kitten"), F.lit("sitting")), e=S.edit_within(F.lit("kitten"), F.lit("sitting"), 2), j=S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), n=S.numbers_differ(F.lit("Vol 1"), F.lit("Vol 2")))
    assert (r["o"], r["k"], r["e"], r["n"]) == (1, 3, -1, True) and r["j"] == pytest.approx(1 / 3)


def test_numbers_differ_only_where_both_name_some(spark):
    differ = lambda a, b: one(spark, x=S.numbers_differ(F.lit(a), F.lit(b)))["x"]
    assert not differ("Mosaico", "Mosaico 2") and not differ("Vol 02", "Vol 2") and differ("No. 1, 2", "No. 2, 3") and not differ("2 y 1", "1 y 2")


def test_year_ranges_with_one_end_are_that_year(spark):
    touch = lambda *e: one(spark, x=S.ranges_overlap(*[F.lit(v).cast("int") for v in e]))["x"]
    assert touch(1990, None, 1995, 2000) is False and touch(1990, None, 1985, 1990) is True and touch(None, 1996, 1995, None) is False
    assert touch(1990, 1996, 1995, None) is True and touch(None, None, 1990, 1991) is None


def test_nearness(spark):
    near = lambda a, b: one(spark, x=S.nearness(F.lit(a), F.lit(b), 2))["x"]
    assert near("la banda", "la banda") == "exact"
    assert near("banda la", "la banda") == "exact"  # small words do not count
    assert near("sol banda", "la banda sol") == "reordered"
    assert near("banda sol", "la banda sol grande") == "contained" and near("banda", "banda grande") is None
    assert near("sol sol", "sol sol") == "exact" and near("luna roja", "lunaroja") == "typo"
    assert near("fernando", "fernanda") == "typo"
    assert near("luna", "sol") is None


def test_partial_dates(spark):
    p = lambda x: one(spark, x=D.partial_date(F.lit(x)))["x"]
    assert p("1992-05") == {"lo": 19920501, "hi": 19920531, "approximate": False, "kind": "month"}
    assert p("~1992")["approximate"] and p("1990/1994")["hi"] == 19941231
    assert p("/2001")["lo"] is None and p("/2001")["hi"] == 20011231
    assert p("sometime") is None
    r = one(spark, a=D.definitely_before(D.partial_date(F.lit("1990")), D.partial_date(F.lit("1991-02"))), b=D.definitely_before(D.partial_date(F.lit("1990/")), D.partial_date(F.lit("1995"))))
    assert r["a"] is True and r["b"] is None


def test_editorial_day(spark):
    r = one(spark, d=D.editorial_day(F.lit("2024-05-01 03:59:00").cast("timestamp")), n=D.daily_index(F.lit("1970-01-12").cast("date"), F.lit(5)))
    assert str(r["d"]) == "2024-04-30" and r["n"] == 1


words = st.text(alphabet="abcd", max_size=6)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_edit_distances_are_symmetric(a, b):
    assert S._osa(a, b) == S._osa(b, a) <= max(len(a), len(b))
    assert 0 <= S._jaro_winkler(a, b) <= 1 and S._jaro_winkler(a, b) == pytest.approx(S._jaro_winkler(b, a), abs=0.2)
