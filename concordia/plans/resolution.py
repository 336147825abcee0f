"""Normalisation, similarity, resolution and evidence fusion on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import resolution as E
from ..registry import Tables, query


# The rules of name keys, said in SQL: white space, quotes, the sign for "and", apostrophes, marks, then leading articles.
KEY_SQL = (
    r"regexp_replace(coalesce(text, ''), '[\p{Z}\s]+', ' ', 'g')",
    r"replace(translate({}, '’‘`´', repeat(chr(39), 4)), '&', ' y ')",
    r"replace(lower({}), chr(39), '')",
    r"trim(regexp_replace(regexp_replace({}, '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g'))",
)
KEY_SQL = KEY_SQL[3].format(KEY_SQL[2].format(KEY_SQL[1].format(KEY_SQL[0])))


@query(f"""SELECT doc_id, k AS primary_key, regexp_replace(k, '^(?:(?:el|la|los|las|un|una|unos|unas|the|a|an) )+(\\S)', '\\1') AS articleless, replace(k, ' ', '') AS compact
            FROM (SELECT doc_id, {KEY_SQL} AS k FROM documents)""")
def n1_name_keys(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", T.name_forms(F.coalesce("text", F.lit(""))).alias("n"))
    return d.select("doc_id", F.col("n.primary").alias("primary_key"), F.col("n.articleless").alias("articleless"), F.col("n.compact").alias("compact"))


@query("""SELECT doc_id, CAST(CASE WHEN regexp_matches(y, '^[0-9]{4}$') AND CAST(y AS INT) BETWEEN 1900 AND 2100 THEN y END AS INT) AS year FROM (SELECT doc_id, CAST(1850 + doc_id % 400 AS VARCHAR) AS y FROM documents)""")
def n6_years(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.year_of((F.lit(1850) + F.col("doc_id") % 400).cast("string")).alias("year"))


@query("""SELECT c_custkey, sha256(concat('{"name":"', c_name, '","nation":', c_nationkey, '}')) AS identity FROM customer""")
def n7_identity_hash(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    return t.customer.select("c_custkey", F.sha2(body, 256).alias("identity"))


@query("""SELECT p_partkey, array_to_string(string_split(regexp_replace(lower(p_name), ' (y|and) ', ',', 'g'), ' '), '|') AS items FROM part""")
def n9_list_split(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", T.genre_items(F.regexp_replace("p_name", " ", ", ")).alias("i"))
    return d.select("p_partkey", F.array_join("i", "|").alias("items"))


@query("""SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents""")
def n15_fold_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fold_accents(F.lower("text")).alias("folded"))


@query("""SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS distance FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b
          ON a.n < b.n AND split_part(a.n, ' ', 2) = split_part(b.n, ' ', 2) WHERE levenshtein(a.n, b.n) <= 4""")
def e3_bounded_edits(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("n")).distinct().withColumn("k", F.split_part("n", F.lit(" "), F.lit(2)))
    d = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "k").filter("a < b")
    return d.select("a", "b", S.edit_within(F.col("a"), F.col("b"), 4).cast("long").alias("distance")).filter("distance >= 0")


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part), g AS (SELECT n, list_distinct(list_transform(range(1, length('  ' || n || ' ') - 1), lambda i: substring('  ' || n || ' ', i, 3))) AS g FROM n)
          SELECT a.n AS a, b.n AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice FROM g a JOIN g b ON a.n < b.n WHERE 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.5""")
def e4_trigram_pairs(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("key")).distinct()
    d = E.gram_pairs(n.select(F.col("key").alias("a"), "key"), n.select(F.col("key").alias("b"), "key"), 0.5)
    return d.filter("a < b").select("a", "b", F.round("dice", 6).alias("dice"))


@query("""WITH s AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
          SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.p, b.p)) * 1.0 / len(list_distinct(list_concat(a.p, b.p))), 6) AS jaccard FROM s a JOIN s b ON a.id + 1 = b.id""")
def e5_jaccard(t: Tables) -> DataFrame:
    s = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("p"))
    d = s.select(F.col("id").alias("a"), F.col("p").alias("pa"), (F.col("id") + 1).alias("b")).join(s.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    return d.select("a", "b", F.round(S.jaccard(F.col("pa"), F.col("pb")), 6).alias("jaccard"))


@query("""WITH p AS (SELECT a.n AS a, b.n AS b, jaro_similarity(a.n, b.n) AS j FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b ON a.n < b.n AND left(a.n, 1) = left(b.n, 1)),
          q AS (SELECT a, b, j, CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3 WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS p FROM p)
          SELECT a, b, round(j + p * 0.1 * (1 - j), 5) AS jw FROM q""")
def e1_jaro_winkler(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("n")).distinct().withColumn("k", F.substring("n", 1, 1))
    d = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "k").filter("a < b")
    return d.select("a", "b", S.jaro_winkler("a", "b").alias("jw"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN a.lo <= b.hi AND b.lo <= a.hi THEN true ELSE false END AS overlap FROM
          (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 1950 + s_suppkey % 40 END, 1960 + s_suppkey % 45) AS lo, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN 1960 + s_suppkey % 45 END, 1950 + s_suppkey % 40) AS hi FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 > 0) a
          JOIN (SELECT s_suppkey, s_nationkey, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 1950 + s_suppkey % 40 END, 1960 + s_suppkey % 45) AS lo, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN 1960 + s_suppkey % 45 END, 1950 + s_suppkey % 40) AS hi FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 > 0) b
          ON a.s_suppkey + 1 = b.s_suppkey""")
def e6_year_ranges(t: Tables) -> DataFrame:
    d = t.supplier.select("s_suppkey", F.expr("case when s_suppkey % 3 > 0 then 1950 + s_suppkey % 40 end").alias("lo"), F.expr("case when s_suppkey % 4 > 0 then 1960 + s_suppkey % 45 end").alias("hi"))
    d = d.filter("lo is not null or hi is not null")
    a = d.select(F.col("s_suppkey").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), (F.col("s_suppkey") + 1).alias("b"))
    b = d.select(F.col("s_suppkey").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return a.join(b, "b").select("a", "b", S.ranges_overlap(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi")).alias("overlap"))


@query("""WITH k AS (SELECT p_partkey AS id, p_name || p_brand || p_type AS key FROM part UNION SELECT p_partkey, p_brand || p_type || p_size FROM part)
          SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id""")
def j14_blocking(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.array(F.concat("p_name", "p_brand", "p_type"), F.concat("p_brand", "p_type", "p_size")).alias("keys"))
    return E.block_pairs(d, "p_partkey", "keys")


@query("""WITH k AS (SELECT DISTINCT least(o_custkey % 200, o_orderkey % 200) AS a, greatest(o_custkey % 200, o_orderkey % 200) AS b FROM orders),
          s AS (SELECT DISTINCT least(s_suppkey, s_nationkey) AS a, greatest(s_suppkey, s_nationkey) AS b FROM supplier)
          SELECT a, b FROM k WHERE a < b AND NOT EXISTS (SELECT 1 FROM s WHERE s.a = k.a AND s.b = k.b)""")
def e25_settled_pairs(t: Tables) -> DataFrame:
    x, y = F.col("o_custkey") % 200, F.col("o_orderkey") % 200
    pairs = t.orders.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct().filter("a < b")
    settled = t.supplier.select(F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"))
    return E.without_settled(pairs, settled)


@query()
def e24_clusters(t: Tables) -> DataFrame:
    """Customers with what they order; reaching all pairs of nodes is too much for SQL, so a test holds it against union-find."""
    e = t.orders.filter("o_orderstatus = 'P'").select((-F.col("o_custkey")).alias("a"), F.col("o_orderkey").alias("b"))
    return E.components(e)


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n, lower(replace(s_name, '#', ' ')) AS k FROM supplier),
          p AS (SELECT a.id AS input_id, b.id AS candidate_id, a.k = b.k AS same, a.n = b.n AS near, round(jaro_similarity('the ' || a.k, b.k), 5) AS jw FROM s a JOIN s b ON a.id // 10 = b.id // 10),
          c AS (SELECT *, round(greatest(0, least(1, CASE WHEN same THEN 0.92::DOUBLE WHEN jw >= 0.76 THEN jw ELSE 0 END * 0.58::DOUBLE + CASE WHEN near THEN 0.12::DOUBLE ELSE -0.12::DOUBLE END)), 5) AS score FROM p),
          r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY input_id ORDER BY score DESC, candidate_id)),
          d AS (SELECT *, CASE WHEN NOT near THEN 'NO_MATCH' WHEN score >= 0.9 THEN 'AUTO_MATCH' WHEN score >= 0.72 THEN 'POSSIBLE_MATCH' WHEN score >= 0.5 THEN 'REVIEW' ELSE 'NO_MATCH' END AS own FROM r WHERE rn = 1)
          SELECT input_id, candidate_id, score, coalesce(second >= 0.5, false) AS contested, CASE WHEN own <> 'NO_MATCH' AND second >= 0.5 AND score - second < 0.08 THEN 'REVIEW' ELSE own END AS decision FROM d""")
def e11_decisions(t: Tables) -> DataFrame:
    """Supplier names with an article before them against the names, in blocks of ten keys, by the artist rules."""
    s = t.supplier.withColumn("k", F.expr("s_suppkey div 10"))
    a = s.select(F.col("s_suppkey").alias("input_id"), T.name_forms(F.concat_ws(" ", F.lit("The"), F.col("s_name"))).alias("i"), F.col("s_nationkey").cast("string").alias("i_country"), "k")
    b = s.select(F.col("s_suppkey").alias("candidate_id"), T.name_forms(F.col("s_name")).alias("c"), F.col("s_nationkey").cast("string").alias("c_country"), "k")
    none, empty = F.lit(None).cast("int"), F.array().cast("array<string>")
    d = a.join(b, "k").withColumns({c: none for c in ("i_from", "i_to", "c_from", "c_to")} | {c: F.lit(None).cast("string") for c in ("i_city", "c_city")} | {c: empty for c in ("i_members", "c_members", "i_discs", "c_discs")})
    aliases = F.filter(F.array("c"), lambda x: F.lit(False))
    d = d.withColumn("jw", S.jaro_winkler(F.col("i.secondary"), F.col("c.secondary")))
    d = E.context_artist(d).withColumn("n", E.compare_names(F.col("i"), F.col("c"), aliases, aliases, F.col("jw")))
    d = E.decide(d.select("input_id", "candidate_id", "n.level", "n.value", "n.low", "context", "signals", "hard"))
    return d.select("input_id", "candidate_id", "score", F.coalesce(F.col("second") >= E.REVIEW, F.lit(False)).alias("contested"), "decision")


@query("""SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)""")
def m1_claim_dedup(t: Tables) -> DataFrame:
    d = t.events.withColumn("day", F.to_date("ts"))
    return E.dedup_claims(d, ["user_id", "event_type", "day"], "event_id").select("event_id", "user_id", "event_type")


MERGE_SQL = """m AS (SELECT l_orderkey, l_linenumber, l_returnflag, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS kept,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"""


@query(f"""WITH {MERGE_SQL} SELECT l_orderkey, CASE WHEN k = 1 THEN 'accepted' WHEN l_returnflag = kept THEN 'unchanged' ELSE 'conflict' END AS outcome, count(*) AS n FROM m GROUP BY 1, 2""")
def m3_merge_policy(t: Tables) -> DataFrame:
    claims = t.lineitem.withColumn("field", F.lit("returnflag"))
    d = E.merge_claims(claims, "l_orderkey", "field", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey"])
    return d.groupBy("l_orderkey", "outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {MERGE_SQL} SELECT l_orderkey, kept, l_returnflag AS other, count(*) AS n FROM m WHERE k > 1 AND l_returnflag <> kept GROUP BY 1, 2, 3""")
def m4_conflicts(t: Tables) -> DataFrame:
    claims = t.lineitem.withColumn("field", F.lit("returnflag"))
    d = E.merge_claims(claims, "l_orderkey", "field", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey"])
    return E.conflicts(d, "l_orderkey", "field", "l_returnflag").drop("field")


@query("""WITH i AS (SELECT l_suppkey, l_partkey, l_linenumber AS s, l_linenumber + CAST(l_quantity AS INT) % 4 AS e FROM lineitem),
          w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
          g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w)
          SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY l_suppkey, k""")
def m8_membership_periods(t: Tables) -> DataFrame:
    from ..operators.relational import islands

    d = t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + F.rint("l_quantity").cast("int") % 4).alias("e"))
    return islands(d, ["l_suppkey"], "s", "e")


@query("""WITH m AS (SELECT s_suppkey AS old, s_suppkey - s_suppkey % 5 AS new FROM supplier WHERE s_suppkey % 5 > 0)
          SELECT DISTINCT l_orderkey, coalesce(new, l_suppkey) AS l_suppkey FROM lineitem LEFT JOIN m ON old = l_suppkey""")
def m9_entity_merge(t: Tables) -> DataFrame:
    m = t.supplier.filter("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - F.col("s_suppkey") % 5).alias("new"))
    d = t.lineitem.select("l_orderkey", "l_suppkey")
    return E.rewrite_keys(d, ["l_suppkey"], m, ["l_orderkey", "l_suppkey"])


@query("""SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, coalesce(h.v, r.v) AS v, CASE WHEN h.v IS NOT NULL THEN 'human' ELSE 'rule' END AS by FROM
          (SELECT doc_id, quality AS v FROM labels) h FULL JOIN (SELECT doc_id, CAST(n_chars > 1000 AS INT) AS v FROM documents) r ON h.doc_id = r.doc_id""")
def m12_human_first(t: Tables) -> DataFrame:
    human = t.labels.select("doc_id", F.col("quality").alias("v"))
    rule = t.documents.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("v"))
    return E.priority(human, rule, ["doc_id"], "v")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE least(1, round(l_discount * 12, 6)) END) AS best, bool_or(l_tax > 0.075) AS disputed FROM lineitem GROUP BY 1, 2),
          g AS (SELECT l_orderkey, avg(best) AS mean, count(*) AS atoms, bool_or(disputed) AS disputed FROM a GROUP BY 1),
          c AS (SELECT l_orderkey, l_suppkey, count(DISTINCT l_linenumber) AS covered, max(least(1, round(l_discount * 12, 6))) AS s FROM lineitem WHERE l_returnflag <> 'N' AND l_discount > 0 GROUP BY 1, 2),
          w AS (SELECT g.*, coalesce((SELECT max(s) FROM c WHERE c.l_orderkey = g.l_orderkey AND c.covered = g.atoms), 1) AS whole FROM g),
          v AS (SELECT *, CASE WHEN disputed AND mean > 0 THEN least(mean, whole, 0.5) WHEN disputed THEN 0 ELSE least(mean, whole) END AS score FROM w)
          SELECT l_orderkey, round(score, 6) AS score, CASE WHEN disputed AND mean = 0 THEN 'contradicted' WHEN score = 1 THEN 'confirmed' WHEN score > 0 THEN 'partial' ELSE 'unverified' END AS status,
                 disputed AND mean > 0 AS conflicted FROM v""")
def v1_coverage_score(t: Tables) -> DataFrame:
    strength = F.when(F.col("l_returnflag") != "N", F.least(F.lit(1.0), F.round(F.col("l_discount") * 12, 6)))
    atoms = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("atom"), F.col("l_suppkey").alias("source"), strength.alias("strength"), (F.col("l_tax") > 0.075).alias("disputed"))
    return E.coverage_score(atoms, ["l_orderkey"]).withColumn("score", F.round("score", 6))
