"""Personal data: base patterns, then bootstrapped contextual extraction; DataFrame functions only.

Seeds are the entities that the base patterns find.  What stands around a seed
and how it is built are its lexical patterns: the word before it, the two words
before it, the word after it, the words on both sides, and its shape.  Patterns
and instances (seeds, and runs of identifier-like words that no base span
overlaps) form a graph, scored in rounds: a pattern is as good as its instances
are, on average, of one kind; an instance is of a kind if one of its patterns
says so; what a round finds supports patterns of the next.  Patterns of high
confidence then mark instances that the base patterns missed: by context where
the string could be of the kind, by shape alone or as a string that is a seed
elsewhere only where it passes the kind's own checks.

Starts and ends count code points.  Base spans stay as they are; found ones
overlap neither them nor each other: the most confident comes first, then the
longest, the leftmost, and the kind by its place in KINDS.

Cases: null text counts as empty; repeated rows get a row each; very long texts
are read whole; other columns may have any names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleared, written

KINDS = ("email", "ip", "card", "phone")

# The patterns are those of the contract.  Guards at the left spare a second
# scan of a run that failed at its start, except right behind the last match
# (\G); possessive quantifiers spare backtracking that cannot help.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: An identifier-like word: one with a digit or an @, or an address with the @ spelled in brackets.
AT, DOT = r"\x20?[(\[]at[)\]]\x20?", r"(?:\x20?[(\[]dot[)\]]\x20?|\.)"
SPELLED = rf"[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
INSTANCE = rf"(?:\G|(?<![^\s]))(?:{SPELLED}|[^\s0-9@]*+[0-9@][^\s]*+)"
RUN = 6  # words of an instance at most, as in +33 1 23 45 67 89


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def step(a: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return a + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(F.substring(digits(m), F.lit(1), F.lit(19)))).otherwise(False)
    return n.between(9, 15)


def holds(kind: str) -> Callable[[Column], Column]:
    return lambda x: valid(kind, x["m"])


def of_kind(i: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == i


BLOCK = 256


def named(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


MATCH = "array<struct<s:int,e:int,m:string,left:string,right:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, left, right>> of the leftmost non-overlapping matches; left, right: the texts up to its neighbours.

    The pieces between matches and the matches alternate, so starts are running
    sums of their lengths, taken by blocks to stay near linear on long texts.
    """
    pieces = F.split(text, pattern, -1)

    def pairs(ls: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m, i: F.struct(F.get(ls, i).alias("left"), m.alias("m"), F.get(ls, i + 1).alias("right")))

    def place(ps: Column) -> Column:
        def both(p: Column) -> Column:
            return F.length(p["left"]) + F.length(p["m"])

        add = lambda a, p: a + both(p)
        n_blocks = F.ceil(F.size(ps) / BLOCK).cast("int")
        block = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.aggregate(F.slice(ps, b * BLOCK + 1, BLOCK), F.lit(0), add))
        begin = F.aggregate(block, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def one(p: Column, i: Column, base: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            before = F.aggregate(F.slice(ps, b * BLOCK + 1, i - b * BLOCK), F.get(base, b), add)
            s = before + F.length(p["left"])
            return F.struct(s.alias("s"), (s + F.length(p["m"])).alias("e"), p["m"].alias("m"), p["left"].alias("left"), p["right"].alias("right"))

        return named(begin, lambda base: F.transform(ps, lambda p, i: one(p, i, base)))

    placed = named(named(pieces, pairs), lambda ps: F.when(F.size(ps) == 0, F.array().cast(MATCH)).otherwise(place(ps).cast(MATCH)))
    return placed


BLANKS = "\t\n\x0b\x0c\r"


def plain(text: Column) -> Column:
    """Lower case, digits alike, all white space blanks."""
    return F.lower(F.translate(text, "012345678" + BLANKS, "9" * 9 + " " * len(BLANKS)))


def last_words(left: Column) -> Column:
    """The last two words of what stands left, whole, however long they are."""
    return F.trim(F.substring_index(F.rtrim(plain(left)), " ", -2))


def first_word(right: Column) -> Column:
    return F.substring_index(F.ltrim(plain(right)), " ", 1)


def shape(m: Column) -> Column:
    """Digits alike, runs of letters alike, white space blanks."""
    return F.regexp_replace(plain(m), "[a-z]+", "a")


def patterns(m: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """The lexical patterns of a string between two last words and a first word."""
    word = F.substring_index(l, " ", -1)
    left, two, right = F.when(word != "", F.concat(F.lit("L "), word)), F.when(l != word, F.concat(F.lit("LL "), l)), F.when(r != "", F.concat(F.lit("R "), r))
    around = F.when((word != "") & (r != ""), F.concat(F.lit("LR "), word, F.lit(" "), r))
    return F.array_compact(F.array(F.concat(F.lit("S "), shape(m)), left, two, right, around))


def fits(kind: Column, m: Column) -> Column:
    """Whether a string that no base pattern took can be of a kind, if its context says so."""
    n = F.length(digits(m))
    return (
        F.when(kind == "email", m.rlike(rf"(?:@|{AT})") & m.rlike("[A-Za-z]"))
        .when(kind == "ip", m.rlike(r"^[0-9]+(?:[.:,][0-9]+){3}$"))
        .when(kind == "card", n.between(12, 19) & m.rlike(r"^[0-9\x20.-]+$"))
        .otherwise(n.between(7, 15) & m.rlike(r"^[+(]*[0-9][0-9\x20()./-]+$"))
    )


def passes(kind: Column, m: Column) -> Column:
    """Whether a string is of a kind by the kind's own form and checks."""
    form = {k: F.regexp_extract(m, "^" + PATTERNS[k].replace(r"(?:\G|(?<![0-9]))", "").replace(rf"(?:\G|(?<![{LOCAL}]))", "") + "$", 0) != "" for k in KINDS}
    out = F.lit(False)
    for k in KINDS:
        out = F.when((kind == k) & form[k], valid(k, m)).otherwise(out)
    return out


def runs(words: Column) -> Column:
    """array<struct<s, e, m, l, r>> of every run of up to RUN neighbouring identifier-like words that could be of a kind.

    Neighbours stand one white space apart; marks of punctuation around a run are not part of it.
    """

    def run(ws: Column, i: Column, j: Column) -> Column:
        part = F.slice(ws, i + 1, j + 1)
        first, last, before, after = F.get(ws, i), F.get(ws, i + j), F.get(ws, i - 1), F.get(ws, i + j + 1)
        m = F.array_join(F.transform(part, lambda w: w["m"]), " ")
        lead = F.length(F.regexp_extract(m, r"""^["'<\[]*""", 0))
        tail = F.length(F.regexp_extract(m, r"""[.,;:!?"'>\]]*$""", 0))
        left = F.when(F.trim(plain(first["left"])) != "", last_words(first["left"])).otherwise(F.coalesce(plain(before["m"]), F.lit("")))
        right = F.when(F.trim(plain(last["right"])) != "", first_word(last["right"])).otherwise(F.coalesce(plain(after["m"]), F.lit("")))
        whole = (last["e"] - first["s"]) == F.length(m)  # gaps of one sign each
        inner = F.substring(m, lead + 1, F.length(m) - lead - tail)
        out = F.struct((first["s"] + lead).alias("s"), (last["e"] - tail).alias("e"), inner.alias("m"), left.alias("l"), right.alias("r"))
        return F.when(whole & (F.length(m) > lead + tail), out)

    def every(ws: Column) -> Column:
        n = F.size(ws)
        steps = lambda i: F.sequence(F.lit(0), F.least(F.lit(RUN), n - i) - 1)
        some = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(steps(i), lambda j: run(ws, i, j))))
        return F.filter(some, lambda x: x.isNotNull() & F.exists(F.array(*[F.lit(k) for k in KINDS]), lambda k: fits(k, x["m"])))

    return named(words, lambda ws: F.when(F.size(ws) > 0, every(ws)).otherwise(F.array().cast(OTHERS)))


OTHERS = "array<struct<s:int,e:int,m:string,l:string,r:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (s, k, e, m, l, r) and others (s, e, m, l, r: runs of identifier-like words that no base span overlaps)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(MATCH)
    for k in KINDS:
        found = F.when(F.col("text").rlike(NEEDS[k]), located(F.col("text"), PATTERNS[k])).otherwise(none)
        d = d.withColumn(k, F.filter(found, holds(k)))
    words = F.when(F.col("text").rlike(rf"[0-9@]|{AT}"), located(F.col("text"), INSTANCE)).otherwise(none)

    def seed(k: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), last_words(x["left"]).alias("l"), first_word(x["right"]).alias("r"))

    base = F.sort_array(F.concat(*[F.transform(kind, seed(k)) for k, kind in enumerate(KINDS)]))
    d = d.withColumn("base", base).withColumn("_i", words)
    free = lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return d.select("doc_id", "base", F.filter(runs(F.filter("_i", free)), free).cast(OTHERS).alias("others"))


def score(seen: DataFrame, rounds: int = 3, least: int = 5, smooth: float = 0.5) -> DataFrame:
    """pattern, kind, confidence, support of every pattern with enough instances of a kind.

    seen: pattern, inst (hash of an instance), kind (of a seed, else null).  In
    each round a pattern's confidence in a kind is the sum of its instances'
    scores over their number plus `smooth`, if `least` of them score above one
    half; an instance that is no seed scores 1 - prod(1 - confidence).
    """
    graph = seen.select("pattern", "inst").distinct()
    size = graph.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= least)  # fewer can never support
    graph = written(graph.join(size, "pattern"), "op3-graph")
    seeds = written(seen.filter("kind is not null").select("inst", "kind").distinct().withColumn("s", F.lit(1.0)), "op3-seeds")
    inst, pat = seeds, None
    for r in range(rounds):
        mass = graph.join(inst, "inst").groupBy("pattern", "kind").agg(F.sum("s").alias("mass"), F.count_if(F.col("s") > 0.5).alias("support"), F.first("size").alias("size"))
        found = mass.filter(F.col("support") >= least).withColumn("confidence", F.least(F.lit(1.0), F.col("mass") / (F.col("size") + smooth)))
        pat = written(found.select("pattern", "kind", "confidence", "support"), "op3-patterns")
        if r < rounds - 1:
            open_ = graph.join(seeds.select("inst").distinct(), "inst", "left_anti").join(pat, "pattern")
            told = open_.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("s"))
            inst = seeds.unionByName(written(told, "op3-instances"))
    return pat


SPAN = "array<struct<s:int,k:int,e:int>>"


def apart(spans: Column) -> Column:
    """Of spans (rank, s, k, e), sorted by rank, those that overlap none before them."""

    def add(a: Column, x: Column) -> Column:
        y = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
        return F.when(F.exists(a, lambda z: (z["s"] < x["e"]) & (x["s"] < z["e"])), a).otherwise(F.concat(a, F.array(y)))

    return F.aggregate(F.sort_array(spans), F.array().cast(SPAN), add)


def personal_data(docs: DataFrame, confidence: float = 0.9, rounds: int = 3, least: int = 5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found; one row per row of docs."""
    rows = written(base_spans(docs).withColumn("_rid", F.monotonically_increasing_id()), "op3-spans")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    of = lambda k: F.element_at(kinds, k + 1)
    with cleared() as keep:
        seeds = rows.select(F.explode("base").alias("x"))
        named_ = seeds.select(F.explode(patterns(F.col("x.m"), F.col("x.l"), F.col("x.r"))).alias("pattern"), F.xxhash64(plain_blanks(F.col("x.m"))).alias("inst"), of(F.col("x.k")).alias("kind"))
        others = rows.select("_rid", F.explode("others").alias("x")).withColumn("inst", F.xxhash64(plain_blanks(F.col("x.m"))))
        told = others.select("_rid", "x", "inst", F.explode(patterns(F.col("x.m"), F.col("x.l"), F.col("x.r"))).alias("pattern"))
        seen = named_.unionByName(told.select("pattern", "inst", F.lit(None).cast("string").alias("kind"))).distinct()
        good = written(score(seen, rounds, least).filter(F.col("confidence") >= confidence), "op3-confident")
        m = F.col("x.m")
        allowed = F.when(F.col("pattern").startswith("S "), passes(F.col("kind"), m)).otherwise(fits(F.col("kind"), m))
        hit = told.join(good, "pattern").filter(allowed).select("_rid", "x", "kind", "confidence")
        known = seeds.select(F.xxhash64(plain_blanks(m)).alias("inst"), of(F.col("x.k")).alias("kind")).distinct()
        hit = hit.unionByName(others.join(known, "inst").filter(passes(F.col("kind"), m)).select("_rid", "x", "kind", F.lit(1.0).alias("confidence")))
        best = hit.groupBy("_rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "kind").agg(F.max("confidence").alias("c"))
        k = (F.array_position(kinds, F.col("kind")) - 1).cast("int")
        rank = F.struct((-F.col("c")).alias("c"), (F.col("s") - F.col("e")).alias("n"), F.col("s"), k.alias("k"), F.col("e"))
        found = keep(written(best.groupBy("_rid").agg(apart(F.collect_list(rank)).alias("found")), "op3-found"))
    d = rows.join(found, "_rid", "left")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    every = F.sort_array(F.concat(base, F.coalesce("found", F.array().cast(SPAN))))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", of(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(every).alias("spans"), F.coalesce(F.size("found"), F.lit(0)).alias("n_found"))


def plain_blanks(m: Column) -> Column:
    """A string with all white space as blanks, by which instances are told apart."""
    return F.translate(m, BLANKS, " " * len(BLANKS))
