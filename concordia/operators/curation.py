"""Curation rules over catalogue-like tables: titles and names that hold what belongs elsewhere, lives, routing, drift, chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Years of age and of grace, and the gap between two eras.
MIN_ACTIVE_AGE, POSTHUMOUS_GRACE, ERA_GAP = 12, 3, 20

YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])"


# -- titles ----------------------------------------------------------------------


def years_in(title: Column) -> Column:
    """Distinct four-digit years that a title names, apart from ranges such as 1990-1995."""
    plain = F.regexp_replace(title, r"(?:19|20)[0-9]{2}\s*[-/]\s*(?:(?:19|20)?[0-9]{2})", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(plain, "([0-9]+)", " $1 "), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def title_year_differs(title: Column, year: Column) -> Column:
    """Whether a title names exactly one year, and it is not the year of release."""
    return (F.size(years_in(title)) == 1) & (F.get(years_in(title), 0) != year)


def impossible_year(year: Column, current: int) -> Column:
    return (year < 1900) | (year > current + 1)


def stuck_words(name: Column) -> Column:
    """A small letter right before a capital, twice or more, or a letter right after a closing sign."""
    return (F.regexp_count(name, F.lit(r"\p{Ll}\p{Lu}")) >= 2) | name.rlike(r"[),;]\p{L}")


def small_start(name: Column) -> Column:
    """A name of letters without any capital."""
    return name.rlike(r"\p{L}") & ~name.rlike(r"\p{Lu}")


def several_names(name: Column) -> Column:
    """The names that one field holds, split at commas, slashes and ampersands outside brackets."""
    parts = F.split(F.regexp_replace(name, r"\([^)]*\)", ""), r"\s*[,/&;]\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def owner_in_title(titles: DataFrame, title: str, owners: DataFrame, owner: str) -> DataFrame:
    """Rows of titles of the form 'name - rest' whose name is one of owners; adds found and rest."""
    mark = r"^(.+?)\s+[-–—]\s+(.+)$"
    d = titles.withColumn("found", F.regexp_extract(title, mark, 1)).withColumn("rest", F.regexp_extract(title, mark, 2)).filter("found <> ''")
    keys = owners.select(F.lower(F.col(owner)).alias("_k")).distinct()
    return d.join(keys, F.lower("found") == F.col("_k"), "left_semi")


def track_range(text: Column) -> Column:
    """Track numbers that a credit names: 'tracks 01-04, 7' gives 1, 2, 3, 4, 7; empty if it names none."""
    listed = F.regexp_extract(text, r"(?i)\b(?:tracks?|pistas?|temas?)\s*:?\s*([0-9]+(?:\s*[-–,]\s*[0-9]+)*)", 1)
    parts = F.filter(F.split(listed, r"\s*,\s*"), lambda p: p != "")

    def numbers(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, "^([0-9]+)", 1).cast("int"), F.regexp_extract(p, "([0-9]+)$", 1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def declared_type(title: Column, words: Mapping[str, str]) -> Column:
    """The one type that a title declares by a word of its own, null for none or several; words: type by pattern."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(title.rlike(rf"(?i)(?:^|[\s(\[]){w}(?:$|[\s)\]])"), F.lit(k)) for w, k in words.items()])))
    return F.when(F.size(found) == 1, F.get(found, 0))


def bracketed(title: Column, pattern: str) -> Column:
    """What stands in brackets at the end of a title, if it matches: credits, dates, tags of a label."""
    inner = F.regexp_extract(title, r"[(\[]([^()\[\]]*)[)\]]\s*$", 1)
    return F.when(inner.rlike(pattern), inner)


def impossible_period(start: Column, end: Column, current: int, born: Column | None = None) -> Column:
    """Why a period cannot be, null if it can: it ends before it starts, lies ahead, or starts before a birth."""
    out = F.when(start > end, "ends_before_start").when((start > current) | (end > current), "in_the_future")
    return out if born is None else out.when(start < born, "before_birth")


def name_collisions(aliases: DataFrame, owner: str, alias: str, names: DataFrame, ident: str, name: str) -> DataFrame:
    """owner, other: an alias of one entity that is the name of another."""
    a = aliases.select(F.col(owner).alias("owner"), F.lower(F.col(alias)).alias("_k"))
    n = names.select(F.col(ident).alias("other"), F.lower(F.col(name)).alias("_k"))
    return a.join(n, "_k").filter("owner <> other").select("owner", "other").distinct()


# -- pairs and lives ---------------------------------------------------------------


def pairs_by_positions(tracks: DataFrame, owner: str, parent: str, position: Sequence[str], least: int = 3) -> DataFrame:
    """a < b, same: two parents of one owner that agree at `least` positions or more (position: number and title key)."""
    d = tracks.select(owner, parent, *position).distinct()
    left, right = d.withColumnRenamed(parent, "a"), d.withColumnRenamed(parent, "b")
    return left.join(right, [owner, *position]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("same")).filter(F.col("same") >= least)


def life_conflicts(d: DataFrame) -> DataFrame:
    """conflict of a person's activity: born, died, year, technical (credits that may come after death); rows without conflict go."""
    early = F.col("year") < F.col("born") + MIN_ACTIVE_AGE
    grace = F.when(F.col("technical"), POSTHUMOUS_GRACE).otherwise(0)
    late = F.col("year") > F.col("died") + grace
    odd = F.col("died") < F.col("born")
    return d.withColumn("conflict", F.when(odd, "dies_before_birth").when(early, "too_young").when(late, "after_death")).filter("conflict is not null")


def eras(d: DataFrame, key: str, year: str, gap: int = ERA_GAP) -> DataFrame:
    """key, era (from 0), first, last: activity falls apart where `gap` years or more lie between two of its years."""
    w = Window.partitionBy(key).orderBy(year)
    x = d.select(key, year).distinct().withColumn("_new", (F.col(year) - F.lag(year).over(w) >= gap).cast("int"))
    x = x.withColumn("era", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "era").agg(F.min(year).alias("first"), F.max(year).alias("last"))


def unique_links(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: str, target: str) -> DataFrame:
    """ident, status (linked, ambiguous, unmatched), target (of what is linked) by equality of keys."""
    n = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(target).alias("_t"))
    d = left.join(n, list(keys), "left")
    status = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "linked").otherwise("ambiguous")
    return d.select(ident, status.alias("status"), F.when(F.col("_n") == 1, F.col("_t")).alias("target"))


# -- claims, runs, findings ----------------------------------------------------------


def dedup_evidence(evidence: DataFrame, claim: str, parts: Sequence[str], ident: str) -> DataFrame:
    """The first evidence (smallest id) of each claim and content."""
    key = F.sha2(F.to_json(F.struct(*parts)), 256)
    return evidence.withColumn("evidence_hash", key).groupBy(claim, "evidence_hash").agg(F.min(ident).alias(ident))


def compact_candidates(decisions: DataFrame, ident: str, candidate: str, score: str, most: int = 20) -> DataFrame:
    """The best `most` candidates of each decision, with their number in all."""
    per = Window.partitionBy(ident)
    d = decisions.withColumn("place", F.row_number().over(per.orderBy(F.desc(score), candidate))).filter(F.col("place") <= most)
    return d.join(decisions.groupBy(ident).agg(F.count("*").alias("n_all")), ident)


def allowed_fields(claims: DataFrame, kind: str, field: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Claims of fields that their kind of entity has."""
    ok = F.lit(False)
    for k, fields in allowed.items():
        ok |= (F.col(kind) == k) & F.col(field).isin(list(fields))
    return claims.filter(ok)


def route(claims: DataFrame, kind: str, targets: Mapping[str, str]) -> DataFrame:
    """target by the kind of claim, never by what it says; kinds without a target go to review."""
    out = F.lit("review")
    for k, t in targets.items():
        out = F.when(F.col(kind) == k, t).otherwise(out)
    return claims.withColumn("target", out)


def propagate(links: DataFrame, props: DataFrame, source: str, target: str, value: str, least: int = 1) -> DataFrame:
    """target, value, n: a property of the sources of a target, where all of them that have one agree and they are `least` or more."""
    d = links.select(source, target).distinct().join(props.select(source, value), source).filter(F.col(value).isNotNull())
    g = d.groupBy(target).agg(F.min(value).alias(value), F.max(value).alias("_hi"), F.count("*").alias("n"))
    return g.filter((F.col(value) == F.col("_hi")) & (F.col("n") >= least)).drop("_hi")


def active_undos(runs: DataFrame, run: str, undoes: str, most: int = 1000) -> DataFrame:
    """run, depth, active of a chain of runs that undo one another: a run holds if an even number of undos stands above it."""
    d = runs.select(F.col(run).alias("run"), F.col(undoes).alias("of"))
    last = runs.sparkSession.sparkContext.getCheckpointDir() is not None
    at = d.join(d.select(F.col("of").alias("run")).distinct(), "run", "left_anti").select("run", F.lit(0).alias("depth"))
    done = at
    for _ in range(most):
        at = at.join(d, "run").filter("of is not null").select(F.col("of").alias("run"), (F.col("depth") + 1).alias("depth"))
        at = at.checkpoint() if last else at
        if not at.head(1):
            break
        done = done.unionByName(at)
    else:
        raise ValueError(f"a chain of more than {most} undos, or a circle")
    return done.groupBy("run").agg(F.max("depth").alias("depth")).withColumn("active", F.col("depth") % 2 == 0)


def stale_findings(old: DataFrame, now: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """key, fixed_by of open findings that a new scan no longer has: the last run that touched the subject, null if none did."""
    gone = old.join(now.select(key), key, "left_anti")
    return gone.select(key).join(journal.groupBy(key).agg(F.max_by("run_id", "id").alias("fixed_by")), key, "left")


def drift(stored: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, drift: missing (derived, not stored) or surplus (stored, not derived)."""
    more = derived.select(*keys).join(stored.select(*keys), list(keys), "left_anti").withColumn("drift", F.lit("missing"))
    return more.unionByName(stored.select(*keys).join(derived.select(*keys), list(keys), "left_anti").withColumn("drift", F.lit("surplus")))


def import_tags(tags: DataFrame, entity: str, tag: str, count: str, least: int, strong: int, most: int) -> DataFrame:
    """Outside tags by policy: at least `least` votes, the `most` best of an entity, strong from `strong` votes on."""
    w = Window.partitionBy(entity).orderBy(F.desc(count), tag)
    d = tags.filter(F.col(count) >= least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return d.select(entity, tag, "place", F.when(F.col(count) >= strong, "strong").otherwise("weak").alias("bucket"))


# -- recommendations -------------------------------------------------------------------


def constrained(labels: DataFrame, item: str, label: str, wanted: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Items that have all wanted labels and none of the unwanted ones, with the number of labels."""
    have = labels.select(item, label).distinct()
    n = wanted.select(label).distinct().agg(F.count("*").alias("_n"))
    whole = have.join(wanted.select(label).distinct(), label).groupBy(item).agg(F.count("*").alias("_k")).join(F.broadcast(n)).filter("_k = _n").select(item)
    clean = whole.join(have.join(unwanted.select(label), label, "left_semi").select(item), item, "left_anti")
    return have.join(clean, item).groupBy(item).agg(F.count("*").alias("n_labels"))


def recommendation_metrics(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, verdict-based measures of recommended items: relevant (null: not judged), owner; a share without a denominator is null."""
    yes, no = F.count_if(F.col("relevant")), F.count_if(~F.col("relevant"))
    known = yes + no
    return judged.groupBy(*keys).agg(
        (yes / F.nullif(known, F.lit(0))).alias("pertinence"),
        (known / F.count("*")).alias("coverage"),
        (F.count_distinct("owner") / F.count("*")).alias("diversity"),
        (known == 0).alias("abstains"),
    )


def effective(assignments: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Approved assignments that hold at a time and that no rejected or withdrawn rival of the same keys contradicts."""
    valid = (F.coalesce(F.col("valid_from") <= at, F.lit(True))) & (F.coalesce(F.col("valid_to") > at, F.lit(True)))
    rivals = assignments.filter(F.col("status").isin("rejected", "withdrawn") & valid).select(*keys)
    return assignments.filter((F.col("status") == "approved") & valid).join(rivals, list(keys), "left_anti")
