"""Titles, roles and verdicts on small hand-made cases."""

from pyspark.sql import functions as F

from concordia.functions import titles as X
from concordia.operators import review as R


def ask(spark, fn, *rows):
    """fn of the text columns c0, c1, ... of the rows, in order."""
    n = len(rows[0])
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r.x for r in d.select("i", fn(*[F.col(f"c{k}") for k in range(n)]).alias("x")).orderBy("i").collect()]


def test_generic_titles(spark):
    assert ask(spark, X.is_generic, ("Vol. II", "Ana"), ("En Vivo 1999", "Ana"), ("La Luna", "Luna"), ("", "Ana"), ("Luna Vol. 2", "Ana")) == [True, True, True, True, False]


def test_title_relations(spark):
    owner = "Los Pasajeros"
    pairs = [("Cinema Cero", "Cinema 0"), ("Pasajeros Noche", "Noche"), ("Noche", "Noche Larga"), ("Madrugadas", "Madurgadas"), ("Demo", "Noche"), ("Sol", "Mar"), ("Vol. I", "Vol. 1")]
    got = ask(spark, X.title_relation, *[(a, b, owner) for a, b in pairs])
    assert got == ["equal", "equal", "contains", "fuzzy", "generic", "unrelated", "equal"]
    assert ask(spark, X.title_relation, *[(b, a, owner) for a, b in pairs]) == got


def test_recordings(spark):
    same = [("Ceniza", "Cenizas"), ("Mercy Mercy", "Mercy, Mercy, Mercy"), ("Luna (Remix)", "Luna [remix]"), ("Luna (feat. Ana)", "Luna"), ("Larga:", "Larga noche")]
    other = [("Luna (Remix)", "Luna"), ("Sol", "Sal"), ("Larga", "Larga noche"), ("", "")]
    assert ask(spark, X.same_recording, *same, *other) == [True] * len(same) + [False] * len(other)


def test_band_keys(spark):
    got = ask(spark, X.band_key, ("1ra Edición",), ("Primera Edición",), ("La Banda de la Banana Voladora",), ("Atkinson - La Banda",), ("Banda",))
    assert got == ["1edicion", "1edicion", "labananavoladora", "atkinson", "banda"]


def test_album_parts(spark):
    got = ask(spark, X.album_part, ("Live in Paris (Lado B)",), ("Noche Vol. 2",), ("Noche, Parte III",), ("Serie de Autores - Vol. I, Manuel",), ("18 años (2003) dvd",), ("Noche Super Deluxe Edition",), ("Noche",), ("Noche CD uno de 3",))
    short = [x and (x.base, x.kind, x.place) for x in got]
    assert short == [("Live in Paris", "side", 2), ("Noche", "volume", 2), ("Noche", "part", 3), ("Serie de Autores, Manuel", "volume", 1), ("18 años", "format", None), ("Noche", "edition", None), None, ("Noche", "disc", 1)]


def test_roles(spark):
    words = {"guitarra": "guitar", "voz": "vocals", "voces": "vocals", "acustica": "acoustic", "lead": ""}
    key = lambda c: X.role_keys(c, words, ["integrante"])
    assert ask(spark, key, ("Guitarra acústica, voz y voces",), ("Integrante",), ("ukeleles (1, 2)",)) == [["acoustic guitar", "vocals"], [], ["ukelele"]]
    same = lambda a, b: X.same_role(key(a), key(b))
    assert ask(spark, same, ("Guitarra", "lead guitar"), ("Guitarra", "Guitarra acústica"), ("Integrante", "integrante")) == [True, False, True]


def test_verdicts(spark):
    schema = "i int, kind string, name string, action string, parent long, same array<long>, seen array<long>, near array<struct<id:long,name:string>>, position long, repertoire map<long,struct<shared:int,total:int,core:int>>, form string, part boolean, bracket boolean"
    rows = [
        ("organization", "Sin sello", None, None, [], [], [], None, {}, None, None, None),
        ("person", "Ana", "AUTO_MATCH", None, [], [], [], None, {}, "ok", True, False),
        ("person", "Ana Luz", "AUTO_MATCH", None, [], [], [], None, {}, "ok", True, True),
        ("person", "Ana Luz", None, None, [], [], [], None, {}, "ok", False, False),
        ("album", "Noche", "NO_MATCH", 1, [7], [7], [], None, {}, None, None, None),
        ("album", "Noche", "NO_MATCH", 1, [7], [8], [], None, {}, None, None, None),
        ("album", "Noche", None, None, [], [], [], None, {}, None, None, None),
        ("album", "Noche Clara", "REVIEW", 1, [], [], [(5, "Noche")], None, {5: (3, 4, 9)}, None, None, None),
        ("album", "Noche Clara", "REVIEW", 1, [], [], [(5, "Noche")], None, {5: (0, 4, 9)}, None, None, None),
        ("album", "Noche Clara", "REVIEW", 1, [], [], [(5, "Noche")], None, {}, None, None, None),
        ("track", "Mosaico Nº 2", "REVIEW", 1, [], [], [(5, "Mosaico Nº 1")], 5, {}, None, None, None),
        ("track", "Mosaicos Nº 1", "REVIEW", 1, [], [], [(5, "Mosaico Nº 1")], 5, {}, None, None, None),
        ("person", "Ana/Luz", "REVIEW", None, [], [], [], None, {}, "ok", False, False),
        ("person", "3:20", "REVIEW", None, [], [], [], None, {}, "duration", False, False),
        ("artist", "Ana", "REVIEW", None, [4], [], [], None, {}, None, None, None),
        ("artist", "Ana", "NO_MATCH", None, [4], [], [], None, {}, None, None, None),
        ("artist", None, "REVIEW", None, None, None, None, None, None, None, None, None),
    ]
    got = R.verdicts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)).orderBy("i").collect()
    assert [r.verdict for r in got] == ["dismiss", "hold", "approve", "hold", "hold", "same", "hold", "same", "different", "hold", "different", "same", "hold", "dismiss", "same", "hold", "different"]
    assert [r.target for r in got if r.verdict == "same"] == [7, 5, 5, 4]


def test_organisation_aliases(spark):
    d = spark.createDataFrame([(1, "Estudio Uno", ["Dos Discos"], [1]), (2, "Dos", [], [1]), (3, "Uno Records", [], []), (4, "Uno Dos", ["uno"], [1]), (5, "Studio", [], [1])], "id int, name string, aliases array<string>, albums array<int>")
    none = d.limit(0).selectExpr("id as a", "id as b")
    got = {(r.a, r.b): r.score for r in R.organisation_pairs(d, none, 0.3).collect()}
    # 1 and 2 share no block; 5 has no word that tells it apart.
    assert got == {(1, 3): 0.6, (1, 4): 0.4, (3, 4): 0.3}
    settled = spark.createDataFrame([(3, 1)], "a int, b int")
    assert (1, 3) not in {(r.a, r.b) for r in R.organisation_pairs(d, settled, 0.3).collect()}


def test_fuzzy_candidates_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) + rng.choice(["", " rock", " pop"]) for _ in range(120)})

    def grams(s):
        p = f"  {s} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    want = set()
    for i, a in enumerate(names):
        best = sorted((-2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))), j) for j, b in enumerate(names))
        want |= {(i, j) for s, j in best[:3] if -s >= 0.72 and len(a) >= 4}
    d = spark.createDataFrame(list(enumerate(names)), "case_id int, key string")
    got = {(r.case_id, r.name_id) for r in R.fuzzy_candidates(d, d.withColumnRenamed("case_id", "name_id")).collect()}
    assert got == want
