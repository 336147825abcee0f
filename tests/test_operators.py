"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from concordia.operators import discovery as V
from concordia.operators import journal as J
from concordia.operators import quality as Q
from concordia.operators import relational as R
from concordia.operators import resolution as E
from concordia.operators import search as Z
from concordia.operators import taxonomy as X

SCORED = "input_id int, candidate_id int, level string, value double, context double, signals int, hard boolean"


def decision(spark, rows, kind="ARTIST"):
    return {r.input_id: r.decision for r in E.decide(spark.createDataFrame(rows, SCORED), kind).collect()}


def test_unique_exact_artist_matches(spark):
    assert decision(spark, [(1, 7, "exact", 1.0, 0.0, 0, False)]) == {1: "AUTO_MATCH"}


def test_homonyms_are_reviewed(spark):
    assert decision(spark, [(1, 7, "exact", 1.0, 0.0, 0, False), (1, 8, "exact", 1.0, 0.0, 0, False)]) == {1: "REVIEW"}


def test_person_without_context_is_a_candidate_at_most(spark):
    assert decision(spark, [(1, 7, "exact", 1.0, 0.0, 0, False)], "PERSON") == {1: "POSSIBLE_MATCH"}
    assert decision(spark, [(1, 10, "exact", 1.0, 0.0, 0, False), (1, 11, "exact", 1.0, 0.0, 0, False)], "PERSON") == {1: "REVIEW"}


def test_album_of_another_artist_never_matches(spark):
    assert decision(spark, [(1, 7, "exact", 1.0, 0.6, 3, True)], "ALBUM") == {1: "REVIEW"}


def test_weak_names_never_match_alone(spark):
    for level, value in (("fuzzy", 0.95), ("article_variant", 0.92), ("accent_only", 0.86)):
        assert decision(spark, [(1, 7, level, value, 0.0, 0, False)])[1] in ("REVIEW", "NO_MATCH", "POSSIBLE_MATCH")


def test_contradictions_are_kept(spark):
    c = spark.createDataFrame([(1, 1, "year", "1992", "system", "high"), (2, 1, "year", "1993", "system", "high"), (3, 1, "year", "1992", "system", "high"), (4, 1, "year", "1999", "ai", "high"), (5, 2, "year", "1980", "system", "low")], "id int, e int, f string, v string, actor string, confidence string")
    d = E.merge_claims(c, "e", "f", "v", ["id"])
    assert [r.outcome for r in d.orderBy("id").collect()] == ["accepted", "conflict", "unchanged", "candidate", "candidate"]
    x = E.conflicts(d, "e", "f", "v").collect()
    assert [(r.kept, r.other) for r in x] == [("1992", "1993")]


def test_stored_values_are_not_overwritten(spark):
    c = spark.createDataFrame([(1, 1, "year", "1992")], "id int, e int, f string, v string")
    stored = spark.createDataFrame([(1, "year", "1990")], "e int, f string, v string")
    assert E.merge_claims(c, "e", "f", "v", ["id"], stored).first().outcome == "conflict"


def test_claim_dedup_is_idempotent(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "id int, k string, t int")
    once = E.dedup_claims(c, ["k", "t"], "id")
    assert sorted(r.id for r in once.collect()) == [1, 3] == sorted(r.id for r in E.dedup_claims(once, ["k", "t"], "id").collect())


def test_components_follow_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r.node: r.component for r in E.components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_clusters_of_the_query_are_those_of_union_find(spark, sf):
    from concordia.registry import QUERIES

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderstatus = 'P'").collect():
        x, y = find(-r.o_custkey), find(r.o_orderkey)
        parent[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in QUERIES["e24_clusters"](spark, sf).collect()} == {x: find(x) for x in parent}


def test_blocks_are_symmetric_and_bounded(spark):
    d = spark.createDataFrame([(i, ["big", f"k{i // 2}"]) for i in range(10)], "id int, keys array<string>")
    p = E.block_pairs(d, "id", "keys", 5)
    assert sorted((r.a, r.b) for r in p.collect()) == [(i, i + 1) for i in range(0, 10, 2)]
    done = spark.createDataFrame([(1, 0)], "a int, b int")
    assert E.without_settled(p, done).count() == 4


def test_net_changes(spark):
    rows = [
        (1, 1, "t", "a", "I", None, {"x": "1"}), (2, 1, "t", "a", "D", {"x": "1"}, None),
        (3, 1, "t", "b", "U", {"x": "1"}, {"x": "2"}), (4, 1, "t", "b", "U", {"x": "2", "y": "5"}, {"x": "3", "y": "6"}),
        (5, 1, "t", "c", "D", {"x": "9"}, None), (6, 2, "t", "b", "U", {"x": "3"}, {"x": "4"}),
    ]
    j = spark.createDataFrame(rows, "id int, run_id int, table_name string, row_pk string, op string, old_data map<string,string>, new_data map<string,string>")
    got = {r.row_pk: r for r in J.undo_plan(j, 1).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"].step == "revert" and got["b"].before == {"x": "1", "y": "5"} and got["b"].after == {"x": "3", "y": "6"} and got["b"].blocked
    assert got["c"].step == "restore" and not got["c"].blocked


def test_trend_abstains_and_decides(spark):
    rows = [("same", 1000, 100, 2000, 200, 7), ("up", 1000, 100, 1000, 200, 7), ("small", 50, 30, 1000, 200, 7), ("gap", 1000, 100, 1000, 200, 6)]
    d = spark.createDataFrame(rows, "k string, imp0 int, acc0 int, imp1 int, acc1 int, days1 int")
    got = {r.k: (r.direction, r.reasons) for r in V.trend(d).collect()}
    assert got == {"same": ("inconclusive", []), "up": ("rising", []), "small": (None, ["insufficient_volume"]), "gap": (None, ["incomplete_days"])}
    d = spark.createDataFrame([(50, 60, 1000, 200, ["x"], ["x", "y"], False), (1000, 300, 1000, 200, ["x"], ["x"], True)], "imp0 int, acc0 int, imp1 int, acc1 int, configs0 array<string>, configs1 array<string>, stable boolean")
    got = [(r.direction, r.reasons) for r in V.trend(d).orderBy("imp0").collect()]
    assert got == [(None, ["identity_changed", "insufficient_volume", "exposure_changed", "invalid_funnel"]), ("falling", [])]


def test_coverage_needs_all_atoms_and_one_whole_source(spark):
    rows = [
        ("whole", 1, "s", 1.0, False), ("whole", 2, "s", 1.0, False), ("parts", 1, "s", 1.0, False), ("parts", 2, "t", 0.6, False),
        ("bound", 1, "s", 1.0, False), ("bound", 1, "t", 0.7, False), ("bound", 2, "t", 0.7, False), ("bound", 2, "s", None, False),
        ("flag", 1, "s", 1.0, True), ("against", 1, None, None, True), ("none", 1, None, None, False),
    ]
    got = {r.k: (round(r.score, 3), r.status, r.conflicted) for r in E.coverage_score(spark.createDataFrame(rows, "k string, atom int, source string, strength double, disputed boolean"), ["k"]).collect()}
    assert got == {
        "whole": (1.0, "confirmed", False), "parts": (0.8, "partial", False), "bound": (0.7, "partial", False),
        "flag": (0.5, "partial", True), "against": (0.0, "contradicted", False), "none": (0.0, "unverified", False),
    }


def test_name_comparisons_in_their_order(spark):
    from concordia.functions import text as T

    def compare(a, b, a_aliases=(), b_aliases=(), jw=0.0, low=()):
        forms = lambda xs: F.array(*[T.name_forms(F.lit(x)) for x in xs]) if xs else F.filter(F.array(T.name_forms(F.lit(""))), lambda x: F.lit(False))
        c = E.compare_names(T.name_forms(F.lit(a)), T.name_forms(F.lit(b)), forms(a_aliases), forms(b_aliases), F.lit(jw), F.array(*[F.lit(x) for x in low]) if low else None)
        r = spark.range(1).select(c.alias("c")).first().c
        return (r.level, r.value, r.low)

    assert compare("Los Amigos", "los amigos") == ("exact", 1.0, False)
    assert compare("Los Amigos", "Amigos") == ("article_variant", 0.92, False)
    assert compare("Los Móviles", "Moviles") == ("none", 0.0, False)  # accents stay in the forms without articles
    assert compare("Rock And Roll", "RockAndRoll") == ("article_variant", 0.90, False)
    assert compare("Canción", "Cancion") == ("accent_only", 0.86, False)
    assert compare("Trío", "Otro", b_aliases=["Trio"]) == ("accent_only", 0.84, False)
    assert compare("Uno", "Dos", a_aliases=["Tres"], b_aliases=["tres"]) == ("alias_exact", 1.0, False)
    assert compare("Uno", "Dos", b_aliases=["uno"], low=["uno"]) == ("alias_exact", 1.0, True)
    assert compare("Una", "Ona", jw=0.8) == ("fuzzy", 0.8, False)


def test_decisions_by_kind(spark):
    assert decision(spark, [(1, 7, "exact", 1.0, 0.5, 2, False)], "ALBUM") == {1: "POSSIBLE_MATCH"}  # albums want three signals
    assert decision(spark, [(1, 7, "exact", 1.0, 0.5, 3, False)], "ALBUM") == {1: "AUTO_MATCH"}
    assert decision(spark, [(1, 7, "exact", 1.0, 0.7, 4, False)], "TRACK") == {1: "POSSIBLE_MATCH"}
    # A conflict takes the anchor away, and the better one of two exact names wins.
    assert decision(spark, [(1, 7, "exact", 1.0, 0.0, 0, True), (1, 8, "fuzzy", 0.9, 0.3, 3, False)]) == {1: "POSSIBLE_MATCH"}
    assert decision(spark, [(1, 7, "fuzzy", 0.95, 0.03, 1, False)]) == {1: "REVIEW"}  # a signal, but too little context


def test_diversify(spark):
    d = spark.createDataFrame([(1, "a", "g1"), (2, "a", "g2"), (3, "a", "g3"), (4, "b", "g1"), (5, "b", "g4")], "id int, owner string, g string")
    got = V.diversify(d, [F.col("id")], "owner", "g", 2).orderBy("round", "id")
    assert [r.id for r in got.collect()] == [1, 5, 2]


def test_funnel_needs_its_order(spark):
    d = spark.createDataFrame([(1, "view", 0), (1, "click", 60), (1, "buy", 30), (2, "view", 0), (2, "click", 2000)], "u int, kind string, s int")
    d = d.select("u", "kind", F.timestamp_seconds("s").alias("ts"))
    got = {r.u: r for r in V.attribute_within(d, ["u"], "view", ["click", "buy"], 15).collect()}
    assert got[1].click is not None and got[1].buy is None and got[2].click is None


def test_genres_agree_whatever_the_order(spark):
    flat = X.lineage(spark.createDataFrame([("rock", None), ("pop", None), ("metal", "rock")], "id string, parent string"))
    rows = [(1, "u1", 0, "rock"), (1, "u1", 1, "pop"), (1, "u2", 0, "rock"), (2, "u1", 0, "rock"), (2, "u2", 0, "pop"), (3, "u1", 0, "rock"), (3, "u1", 1, "metal")]
    for order in (rows, rows[::-1]):
        got = {(r.entity, r.node): (r.role, r.status, r.rule) for r in X.agree(spark.createDataFrame(order, "entity int, unit string, place int, node string"), flat).collect()}
        assert got[1, "rock"] == ("primary", "confirmed", "sources_agree")
        assert got[1, "pop"][2] == "partial_source_agreement"
        assert got[2, "rock"][1] == got[2, "pop"][1] == "suggested"
        assert (3, "rock") not in got and got[3, "metal"][0] == "primary"


def test_search_tiers(spark):
    e = spark.createDataFrame([("artist", 1, "Soda", None, 5), ("artist", 2, "Soda Stereo", None, 9), ("artist", 3, "La Soda", None, 1), ("artist", 4, "Gasosoda", ["Zeta"], 2)], "kind string, entity_id int, name string, aliases array<string>, weight int")
    ix = Z.build_index(e)
    assert [r.entity_id for r in Z.search(ix, "sóda").orderBy("place").collect()] == [1, 2, 3, 4]
    assert [r.entity_id for r in Z.search(ix, "so").orderBy("place").collect()] == [2, 1, 3]
    assert Z.search(ix, "zeta").first().entity_id == 4


def test_evidence_logic(spark):
    s = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, True)], "condition int, supports boolean, counters boolean")
    c = spark.createDataFrame([("a", 1, 0, True), ("b", 1, 0, True), ("b", 2, 1, True), ("c", 2, 0, True), ("c", 1, 0, True), ("d", 3, 0, True), ("e", 9, 0, True), ("f", 1, 0, False)], "q string, condition int, grp int, hard boolean")
    got = {r.q: r.status for r in E.evidence_status(s, c, ["q"]).collect()}
    assert got == {"a": "supported_as_attributed", "b": "not_supported", "c": "supported_as_attributed", "d": "conflicted", "e": "unresolved", "f": "preference_only"}


def test_relational_idioms(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "s int, t int")
    assert {r.t for r in R.follow(p, "s", "t").collect()} == {20}
    d = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8)], "k int, s int, e int")
    assert sorted((r.s, r.e, r.parts) for r in R.islands(d, ["k"], "s", "e").collect()) == [(1, 5, 2), (7, 8, 1)]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    once = R.upsert(a, b, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")] == sorted(map(tuple, R.upsert(once, b, ["id"]).collect()))
    assert sorted(map(tuple, R.insert_missing(a, b, ["id"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_text_rules(spark):
    d = spark.createDataFrame([(1, "a  b"), (2, "R&amp;B"), (3, "open (bracket"), (4, "MAYUSCULAS"), (5, "fine")], "id int, t string")
    got = sorted((r.subject, r.detector) for r in Q.text_findings(d, "id", "t").collect())
    assert got == [("1", "irregular_spaces"), ("2", "html_entities"), ("3", "unclosed_signs"), ("4", "sustained_capitals")]


def test_findings_once_per_fingerprint(spark):
    d = spark.createDataFrame([(1,), (1,)], "id int")
    f = Q.finding(d, "x", F.col("id"), F.lit(None))
    assert Q.findings({"a": f, "b": f}).count() == 1


def test_periods_with_gaps_and_fractions(spark, tmp_path):
    import duckdb
    import concordia.plans  # noqa: F401
    from concordia.registry import ORACLE_SQL, QUERIES

    rows = [
        (1, 7, 1, 2.6), (1, 8, 5, 1.0),  # 2.6 is rounded: 1 to 4
        (2, 7, 1, 4.0), (2, 7, 1, None), (2, 7, 3, None), (2, 7, 4, 5.0),
        (3, 7, None, 1.0), (3, 7, None, 2.0), (3, 7, 2, 2.5), (None, 7, 2, 3.5),
    ]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in QUERIES["m8_membership_periods"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(ORACLE_SQL["m8_membership_periods"]).fetchall(), key=str)
    assert (1, 1, 4, 1) in got and (3, None, None, 1) in got
