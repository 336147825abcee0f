"""Review work on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles as X
from ..operators import review as R
from ..registry import Tables, query


@query("""SELECT p_partkey, p_size % 4 <> 3 AS generic FROM part""")
def n12_generic_titles(t: Tables) -> DataFrame:
    owner = F.concat(F.lit("The "), "p_name")
    title = F.when(F.col("p_size") % 4 == 0, "Demo en vivo, Vol. II").when(F.col("p_size") % 4 == 1, "2024").when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" demo")))
    return t.part.select("p_partkey", X.is_generic(title, owner).alias("generic"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'equal' WHEN 1 THEN 'contains' WHEN 2 THEN 'generic' WHEN 3 THEN 'fuzzy' ELSE 'unrelated' END AS relation FROM part""")
def e22_title_relations(t: Tables) -> DataFrame:
    left = F.concat(F.lit("Tren al Sur "), "p_brand")
    right = {0: F.concat(F.lit("El Tren Al Sur, "), "p_brand"), 1: F.concat(F.lit("Noche: tren al sur "), "p_brand"), 2: F.lit("Demos Vol. 2"), 3: F.concat(F.lit("Tern al Sur "), "p_brand")}
    other = F.lit("Madrugada")
    for k, v in right.items():
        other = F.when(F.col("p_size") % 5 == k, v).otherwise(other)
    return t.part.select("p_partkey", X.title_relation(left, other, F.lit("Los Pasajeros")).alias("relation"))


@query("""SELECT p_partkey, p_size % 4 = 0 OR p_size % 4 = 1 AND length(replace(p_name, ' ', '')) >= 8 AS same FROM part""")
def e23_recordings(t: Tables) -> DataFrame:
    other = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" (feat. Ana)"))).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" again")))
    other = F.coalesce(other, F.when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit(" (Remix)"))).otherwise("Ceniza"))
    return t.part.select("p_partkey", X.same_recording(F.col("p_name"), other).alias("same"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'la' ELSE '' END || (1 + p_size % 3) || 'edicion' || replace(p_name, ' ', '') AS key FROM part""")
def n14_band_keys(t: Tables) -> DataFrame:
    word = F.when(F.col("p_size") % 3 == 0, "La Banda de la Primera").when(F.col("p_size") % 3 == 1, "2da").otherwise("Tercera")
    return t.part.select("p_partkey", X.band_key(F.concat(word, F.lit(" Edición "), "p_name", F.lit(" y su orquesta"))).alias("key"))


@query("""SELECT p_partkey, p_name || CASE p_size % 5 WHEN 3 THEN ', Luz' ELSE '' END AS base, CASE p_size % 5 WHEN 0 THEN 'disc' WHEN 1 THEN 'side' WHEN 2 THEN 'format' WHEN 3 THEN 'volume' ELSE 'edition' END AS kind,
          CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 4 END AS place FROM part""")
def m10_album_parts(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_size") % 5 == 0, " - Disco 2/3").when(F.col("p_size") % 5 == 1, " (Lado A)").when(F.col("p_size") % 5 == 2, " (2003) dvd").when(F.col("p_size") % 5 == 3, " - Vol. IV, Luz").otherwise(" [Deluxe Edition]")
    return t.part.select("p_partkey", X.album_part(F.concat("p_name", tail)).alias("x")).select("p_partkey", "x.base", "x.kind", "x.place")


@query("""SELECT p_partkey, p_size % 3 <> 2 AS same FROM part""")
def m7_same_roles(t: Tables) -> DataFrame:
    words = {"guitarra": "guitar", "guitarras": "guitar", "guitarrista": "guitar", "voz": "vocals", "vocals": "vocals", "coros": "vocals", "acustica": "acoustic", "lead": ""}
    a, b = F.lit("Guitarra (acústica), voz y coros"), F.when(F.col("p_size") % 3 == 0, "lead vocals / acoustic guitars (tracks 1, 2)").when(F.col("p_size") % 3 == 1, "VOZ & Guitarra acústica").otherwise("guitar, voz")
    key = lambda c: X.role_keys(c, words, ["integrante", "member"])
    return t.part.select("p_partkey", F.coalesce(X.same_role(key(a), key(b)), F.lit(False)).alias("same"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'approve' WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 0 THEN 'hold' WHEN o_orderkey % 4 = 0 AND o_custkey % 5 = 1 AND o_orderstatus = 'O' THEN 'hold' WHEN o_orderkey % 4 = 0 AND o_custkey % 5 = 1 THEN 'same'
            WHEN o_orderkey % 4 = 0 THEN 'different' WHEN o_orderkey % 4 = 1 AND o_custkey % 5 = 1 AND o_orderstatus = 'P' THEN 'same' WHEN o_orderkey % 4 = 1 THEN 'hold' WHEN o_orderkey % 4 = 2 THEN 'different' ELSE 'dismiss' END AS verdict,
          CASE WHEN o_orderstatus <> 'F' AND o_custkey % 5 = 1 AND o_orderstatus = 'P' AND (o_orderkey % 4 = 1 OR o_orderkey % 4 = 0 AND o_custkey % 3 > 0) THEN o_custkey END AS target
          FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)""")
def e16_verdicts(t: Tables) -> DataFrame:
    d = t.orders.selectExpr(
        "o_orderkey", "element_at(array('album', 'artist', 'person', 'organization'), int(o_orderkey % 4) + 1) as kind",
        "case when o_orderkey % 4 = 3 then 'Sin Sello' when o_orderkey % 4 = 1 then 'Los Pasajeros' else 'Noche Clara' end as name",
        "case o_orderstatus when 'F' then 'AUTO_MATCH' when 'O' then 'NO_MATCH' else 'REVIEW' end as action",
        "case when o_custkey % 3 > 0 then o_custkey end as parent", "case when o_custkey % 5 = 1 then array(o_custkey) else array() end as same",
        "cast(array() as array<bigint>) as seen", "case when o_orderkey % 4 = 1 then array(named_struct('id', o_custkey + 1, 'name', 'Pasajeros')) end as near",
        "cast(null as bigint) as position", "cast(null as map<bigint, struct<shared:int,total:int,core:int>>) as repertoire", "'ok' as form", "false as part", "false as bracket",
    )
    return R.verdicts(d).select("o_orderkey", "verdict", "target")


@query("""WITH d AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'uno' || (s_suppkey // 6) ELSE 'uno' || (s_suppkey // 6) || ' ' || CASE WHEN s_suppkey % 3 = 1 THEN 'azul' ELSE 'azull' END END AS key, s_suppkey % 2 AS album FROM supplier),
          p AS (SELECT a.id AS a, b.id AS b, a.key = b.key AS eq, jaro_winkler_similarity(a.key, b.key) AS jw, a.album = b.album AS one FROM d a JOIN d b ON a.id < b.id AND split_part(a.key, ' ', 1) = split_part(b.key, ' ', 1) WHERE NOT (a.id % 10 = 0 AND b.id = a.id + 3)),
          s AS (SELECT a, b, round(CASE WHEN eq THEN 0.6 ELSE 0.0 END + CASE WHEN NOT eq AND jw >= 0.92 THEN round(0.1 * round(jw, 5), 4) ELSE 0.0 END + CASE WHEN one THEN 0.1 ELSE 0.0 END, 4) AS score FROM p)
          SELECT a, b, score, CASE WHEN score >= 0.6 THEN 3 ELSE 6 END AS priority FROM s WHERE score >= 0.15""")
def e19_organisation_pairs(t: Tables) -> DataFrame:
    d = t.supplier.selectExpr(
        "s_suppkey as id", "concat('Estudio UNO', s_suppkey div 6, case s_suppkey % 3 when 0 then ' Records' when 1 then ' Azul' else ' Azull, Films' end) as name",
        "cast(null as array<string>) as aliases", "array(s_suppkey % 2) as albums",
    )
    settled = t.supplier.filter("s_suppkey % 10 = 0").selectExpr("s_suppkey + 3 as a", "s_suppkey as b")
    return R.organisation_pairs(d, settled, 0.15)


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part), g AS (SELECT n, list_distinct(list_transform(range(1, length('  ' || n || ' ') - 1), lambda i: substring('  ' || n || ' ', i, 3))) AS g FROM n),
          s AS (SELECT a.n AS x, b.n AS y, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS score FROM g a JOIN g b ON a.n <> b.n)
          SELECT x AS case_id, y AS name_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS place FROM s WHERE score >= 0.5) WHERE place <= 3""")
def g8_fuzzy_candidates(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("key")).distinct()
    d = R.fuzzy_candidates(names.select(F.col("key").alias("case_id"), "key"), names.select(F.col("key").alias("name_id"), "key"), 0.5, 4)
    # A name is no candidate for itself; it stands first of all.
    return d.filter("case_id <> name_id").withColumn("place", F.col("place") - 1)


@query("""WITH f AS (SELECT 'album' AS kind, o_custkey AS id, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'disagreement' END AS d, bool_or(o_orderkey % 7 = 0) AS radio FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey),
          u AS (SELECT 'album' AS kind, c_custkey AS id, NULL AS d, c_custkey % 11 = 0 AS radio FROM customer WHERE c_custkey NOT IN (SELECT id FROM f) AND NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 1)
                UNION ALL SELECT 'artist', s_suppkey, NULL, s_suppkey % 11 = 0 FROM supplier)
          SELECT kind, id AS entity_id, CASE WHEN radio THEN CASE kind WHEN 'album' THEN 1 ELSE 2 END WHEN d IS NOT NULL THEN 3 WHEN kind = 'album' THEN 4 ELSE 5 END AS tier FROM (SELECT * FROM f UNION ALL SELECT * FROM u)""")
def g11_curation_queue(t: Tables) -> DataFrame:
    flagged = t.orders.filter("o_orderstatus = 'P'").selectExpr("'album' as kind", "o_custkey as entity_id", "case when o_orderkey % 2 = 0 then 'disagreement' else 'unmapped' end as category", "o_orderkey % 7 = 0 as radio", "1 as n_tracks")
    albums = t.customer.selectExpr("'album' as kind", "c_custkey as entity_id", "c_custkey % 11 = 0 as radio", "1 as n_tracks")
    artists = t.supplier.selectExpr("'artist' as kind", "s_suppkey as entity_id", "s_suppkey % 11 = 0 as radio", "1 as n_tracks")
    log = t.customer.filter("c_custkey % 3 = 0").selectExpr("'album' as kind", "c_custkey as entity_id", "explode(array(struct(1 as id, 'insufficient_evidence' as action), struct(2 as id, if(c_custkey % 2 = 0, 'reopen', 'note') as action))) as x")
    return R.curation_queue(flagged, albums.unionByName(artists), log.select("kind", "entity_id", "x.id", "x.action")).select("kind", "entity_id", "tier")


@query("""WITH d AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'energy' WHEN 'click' THEN 'activity' END AS axis, user_id % 2 = 0 AS ok, user_id % 3 = 0 AS neg FROM events WHERE event_id % 4 > 0)
          SELECT sha256('["' || user_id || '","' || event_type || '","c","1","1","' || e.event_id || '"]') AS unit_key, CAST(1 + CAST(axis IS NULL AS INT) + CAST(NOT ok AS INT) + 2 * CAST(axis IS NOT NULL AND axis IN ('activity', 'energy') AS INT) - CAST(axis IS NOT NULL AS INT) + CAST(neg AS INT) AS INT) AS n
          FROM d JOIN events e ON e.event_id = d.event_id""")
def q10_knowledge_units(t: Tables) -> DataFrame:
    d = t.events.selectExpr(
        "user_id as resource", "event_type as source", "'c' as capture", "1 as extractor", "1 as schema", "event_id as annotation_id", "cast(null as string) as reference",
        "case event_type when 'view' then 'energy' when 'click' then 'activity' end as axis", "if(user_id % 2 = 0, 'resolved', 'open') as object",
        "if(user_id % 3 = 0, 'negated', 'affirmed') as state", "cast(null as string) as basis", "cast(null as string) as coverage", "cast(null as string) as method",
    )
    key = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in ("resource", "source", "capture", "extractor", "schema", "annotation_id")])), 256)
    known = d.filter("annotation_id % 4 = 0").select(key.alias("unit_key"))
    return R.knowledge_units(d, known).select("unit_key", F.size("blockers").alias("n"))
