"""Person pairs, intents and upkeep on small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from concordia.functions import titles as X
from concordia.operators import admin as A
from concordia.operators import persons as P

SCHEMA = "id int, name string, aliases array<string>, born int, died int, bands array<int>, albums array<int>, artists array<int>, colleagues array<int>"


def pairs(spark, rows, least=0.0, settled=()):
    d = spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], SCHEMA)
    s = spark.createDataFrame(list(settled), "a int, b int")
    return {(r.a, r.b): (r.score, {f.key for f in r.features}) for r in P.person_pairs(d, s, least).collect()}


def test_nicknames_and_aliases(spark):
    got = pairs(spark, [(1, 'Alberto "Beto" Montenegro'), (2, "Alberto Montenegro"), (3, "Beto Monetegro"), (4, "Ana Luz"), (5, "Ana Luz", ["Alberto Montenegro"])])
    assert got[(1, 2)] == (0.6, {"nickname_equal", "jaro_winkler"})
    assert got[(1, 3)] == (0.45, {"name_variant"})
    assert got[(2, 3)][1] >= {"name_variant"} and got[(2, 3)][0] == pytest.approx(0.3)
    assert "alias_cross" in got[(2, 5)][1] and "first_last_equal" in got[(4, 5)][1]


def test_contradictions_and_context(spark):
    rows = [(1, "Ana Paz", [], 1970, None, [1], [2]), (2, "Ana Paz", [], 1971, None, [1], [2]), (3, "Ana Paz", None, None, None, [1], [2]), (4, "Ana Paz Records"), (5, None), (6, "")]
    got = pairs(spark, rows)
    assert set(got) == {(1, 3), (2, 3)} and got[(1, 3)][0] == 0.75
    assert set(pairs(spark, rows, settled=[(3, 1)])) == {(2, 3)}
    clash = pairs(spark, [(1, "Ana Luz Paz"), (2, "Ana Mar Paz")])
    assert "middle_name_clash" in clash[(1, 2)][1]
    far = pairs(spark, [(1, "Ana Paz", [], None, None, [], [], [7], [8, 9]), (2, "Ana Paz", [], None, None, [], [], [7], [8, 9])])
    assert far[(1, 2)] == (0.6, {"first_last_equal", "jaro_winkler", "shared_artist", "shared_colleagues"})


def test_intents(spark):
    d = spark.createDataFrame([(0, "Canciones ¡tristes!"), (1, "para tener fiesta"), (2, "as"), (3, ""), (4, None), (5, "triste, para tener fiesta")], "i int, q string")
    rules = [("joy", ["para tener fiesta"]), ("sad", ["triste"])]
    assert [r.x for r in d.select("i", X.phrase_intent(F.col("q"), rules).alias("x")).orderBy("i").collect()] == ["sad", "joy", None, None, None, "joy"]


def test_pages_meet_without_gap(spark):
    d = spark.createDataFrame([(i // 3, i) for i in range(20)], "a long, b long")
    seen, after = [], None
    while page := A.keyset_page(d, ["a", "b"], after, 6).collect():
        seen += [r.b for r in page]
        after = tuple(page[-1])
    assert seen == list(range(19, -1, -1))


def test_fingerprint_of_rows_in_any_order(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    of = lambda x: A.fingerprint({"t": (x, ["i", "s"])}).collect()
    assert of(d) == of(d.orderBy(F.desc("i"))) != of(d.filter("i = 1")) and of(d.limit(0))[0].digest == "0"
