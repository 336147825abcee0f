"""Curation rules on small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from concordia.operators import curation as C


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_years_in_titles(spark):
    years = lambda s: one(spark, C.years_in(F.lit(s)))
    assert years("Live 1991") == [1991] and years("1990-1995") == [] and years("From 1991 to 1992") == [1991, 1992] and years("Nº 19911") == []
    assert one(spark, C.title_year_differs(F.lit("Live 1991"), F.lit(1993))) and not one(spark, C.title_year_differs(F.lit("1991 and 1992"), F.lit(1993)))


def test_track_ranges(spark):
    got = lambda s: one(spark, C.track_range(F.lit(s)))
    assert got("guitar (tracks 01-04, 7)") == [1, 2, 3, 4, 7] and got("Pista 3") == [3] and got("guitar") == [] and got("tracks 5-2") == []


def test_names_that_hold_more(spark):
    assert one(spark, C.several_names(F.lit("Ana & Luis / Eva (a, b)"))) == ["Ana", "Luis", "Eva"]
    assert one(spark, C.stuck_words(F.lit("LaBandaRoja"))) and not one(spark, C.stuck_words(F.lit("McCartney")))
    assert one(spark, C.small_start(F.lit("la banda"))) and not one(spark, C.small_start(F.lit("La banda"))) and not one(spark, C.small_start(F.lit("123")))
    assert one(spark, C.bracketed(F.lit("Song (feat. Ana)"), "(?i)^feat")) == "feat. Ana" and one(spark, C.bracketed(F.lit("Song (Live)"), "(?i)^feat")) is None
    words = {"live": "live", "ep": "ep"}
    assert [one(spark, C.declared_type(F.lit(x), words)) for x in ("Songs (Live)", "Songs EP", "Live EP", "Alive")] == ["live", "ep", None, None]


def test_lives(spark):
    d = spark.createDataFrame([(1, 1980, None, 1990, False), (2, 1950, 1980, 1982, True), (3, 1950, 1980, 1982, False), (4, 1990, 1980, 1985, False), (5, 1950, None, 1980, False)], "k int, born int, died int, year int, technical boolean")
    assert {r.k: r.conflict for r in C.life_conflicts(d).collect()} == {1: "too_young", 3: "after_death", 4: "dies_before_birth"}
    e = spark.createDataFrame([("a", y) for y in (1970, 1975, 1995, 1996)] + [("b", 1980)], "k string, y int")
    assert sorted((r.k, r.era, r.first, r.last) for r in C.eras(e, "k", "y").collect()) == [("a", 0, 1970, 1975), ("a", 1, 1995, 1996), ("b", 0, 1980, 1980)]


def test_undos_of_undos(spark):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "run int, of int")
    assert {r.run: r.active for r in C.active_undos(d, "run", "of").collect()} == {1: True, 2: False, 3: True, 4: True}
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "run int, of int")
    with pytest.raises(ValueError):
        C.active_undos(ring, "run", "of", 5)


def test_measures_without_a_denominator_are_null(spark):
    d = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, True, "x"), (2, False, "x"), (2, None, "x")], "q int, relevant boolean, owner string")
    got = {r.q: (r.pertinence, r.coverage, r.abstains) for r in C.recommendation_metrics(d, ["q"]).collect()}
    assert got[1] == (None, 0.0, True) and got[2] == (0.5, pytest.approx(2 / 3), False)
