"""Review work: verdicts by policy, pairs of organisations, fuzzy candidates, queues, units of knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .resolution import block_pairs, gram_pairs, without_settled

# Words that do not tell organisations apart, names that stand for no label, scores of a proposal.
ORGANISATION_WORDS = r"(?i)\b(?:estudios?|studios?|records|producciones|productora|discos|sello|label|mastering|films?)\b"
NO_LABEL = r"(?i)^(?:independent|independiente|self[- ]?released|autoeditad[oa]|sin sello|no label|n/a|varios|various)$"
PROPOSED, STRONG = 0.45, 0.60


def near_refs(name: Column, refs: Column, least_tokens: int = 1) -> Column:
    """The refs, structs with a name, that are near a name."""
    return F.filter(refs, lambda r: S.nearness(T.secondary_key(name), T.secondary_key(r["name"]), least_tokens).isNotNull())


def verdicts(d: DataFrame) -> DataFrame:
    """Adds verdict (approve, same, different, dismiss, hold), rule and target (of same) to open identities.

    kind: artist, organization, person, album or track.  name.  action: what
    resolution decided, null without a decision.  parent: of an album or track,
    null while unresolved.  same: ids of entities of the same name (and parent).
    seen: ids that resolution compared.  near: array of struct(id, name) of
    candidates (of the same parent, for albums and tracks), of which only near
    ones count.  position: id of the track at the same place.  repertoire:
    map from id to struct(shared, total, core), tracks in common with an album.
    form: what the name is (ok, label, quoted, list, duration, fragment, title,
    group, ...).  part, bracket: whether it was only ever seen as a part of a
    multiple credit, or in brackets after titles.
    """
    is_ = lambda *ks: F.col("kind").isin(*ks)
    auto = F.coalesce(F.col("action") == "AUTO_MATCH", F.lit(False))
    against = F.coalesce(F.col("action") == "NO_MATCH", F.lit(False))
    undecided = F.col("action").isNull()
    form = F.coalesce("form", F.lit("ok"))
    n_same = F.size(F.coalesce("same", F.array().cast("array<bigint>")))
    first = F.get("same", 0)
    child = is_("album", "track")
    refs = F.coalesce("near", F.array().cast("array<struct<id:bigint,name:string>>"))
    near = F.when(is_("person"), near_refs(F.col("name"), refs, 2)).otherwise(near_refs(F.col("name"), refs))
    saw = ~undecided & ((F.size(F.coalesce("seen", F.array().cast("array<bigint>"))) == 0) | F.array_contains("seen", first))
    words = F.size(F.filter(F.split(T.secondary_key(F.col("name")), " "), lambda w: w != ""))
    initials = F.col("name").rlike(r"(?:^|[\s.])\p{L}\.(?=\s|\p{L}|$)")
    linked = auto & ((words >= 2) | (n_same == 1))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))

    # Of near albums, those with tracks enough to compare, and of these the ones that share half of them.
    shared = lambda r: F.try_element_at("repertoire", r["id"])
    measured = F.filter("_near", lambda r: F.coalesce((shared(r)["total"] >= 2) & (shared(r)["core"] > 0), F.lit(False)))
    sharing = F.filter(measured, lambda r: shared(r)["shared"] * 2 >= shared(r)["total"])
    apart = (F.size(measured) == F.size("_near")) & F.forall(measured, lambda r: shared(r)["shared"] == 0)
    at_place = F.get(F.filter("_near", lambda r: r["id"] == F.col("position")), 0)
    other_number = F.forall("_near", lambda r: S.numbers_differ(F.col("name"), r["name"]))
    some = F.size("_near") > 0

    rules: list[tuple[Column, str, str, Column | None]] = [
        (is_("organization") & F.col("name").rlike(NO_LABEL), "dismiss", "no_label", None),
        (is_("person") & (form == "label"), "hold", "no_person_label", None),
        (is_("person") & (form == "quoted") & ~auto, "hold", "no_person_quoted", None),
        (is_("person") & flag("part") & ((words < 2) | initials) & ~linked, "hold", "part_of_credit", None),
        (is_("person") & flag("bracket") & ~(auto & (words >= 2)), "hold", "title_bracket", None),
        (auto, "approve", "auto_match", None),
        (undecided & ~(child & F.col("parent").isNotNull()), "hold", "no_decision", None),
        (child & F.col("parent").isNull(), "hold", "parent_open", None),
        (child & (n_same > 1), "hold", "several_of_the_title", None),
        (child & (n_same == 1) & against & saw, "hold", "same_title_contradicted", None),
        (child & (n_same == 1), "same", "same_title", first),
        (is_("track") & some & at_place.isNotNull() & ~S.numbers_differ(F.col("name"), at_place["name"]), "same", "near_title_same_place", at_place["id"]),
        (is_("track") & some & other_number, "different", "near_title_other_number", None),
        (is_("album") & some & (F.size(sharing) == 1), "same", "near_title_same_tracks", F.get(sharing, 0)["id"]),
        (is_("album") & some & (F.size(sharing) == 0) & apart, "different", "near_title_other_tracks", None),
        (child & some, "hold", "near_title", None),
        (child & undecided, "different", "nothing_near", None),
        (child & against, "different", "no_match", None),
        (child, "different", "other_parent_only", None),
        (is_("person") & F.contains("name", F.lit("/")), "hold", "no_person_list", None),
        (is_("person") & form.isin("duration", "fragment"), "dismiss", "junk", None),
        (is_("person") & (form != "ok"), "hold", "no_person_other", None),
        (is_("person") & (n_same > 0), "different", "namesake", None),
        (is_("person") & some, "different", "near_name", None),
        (is_("person") & against, "different", "no_match", None),
        (is_("person"), "different", "weak_only", None),
        ((n_same == 1) & ~against, "same", "same_name", first),
        (n_same > 0, "hold", "same_name_in_catalogue", None),
        (some, "hold", "near_name", None),
        (against, "different", "no_match", None),
    ]
    out = F.struct(F.lit("different").alias("verdict"), F.lit("weak_only").alias("rule"), F.lit(None).cast("long").alias("target"))
    for holds, verdict, rule, target in reversed(rules):
        answer = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"), (F.lit(None) if target is None else target).cast("long").alias("target"))
        out = F.when(holds, answer).otherwise(out)
    return d.withColumn("_near", near).withColumn("_v", out).select(*[F.col(c) for c in d.columns], "_v.verdict", "_v.rule", "_v.target")


def organisation_key(name: Column) -> Column:
    return T.secondary_key(F.regexp_replace(name, ORGANISATION_WORDS, " "))


def organisation_pairs(orgs: DataFrame, settled: DataFrame, least: float = PROPOSED, most: int = 25) -> DataFrame:
    """a < b, score, priority of organisations (id, name, aliases, albums) that may be one.

    Blocks are the key and its first word; a block of more than `most` names is
    too common to tell anything.  A pair scores 0.6 for equal keys, 0.3 for an
    alias of one that names the other, a tenth of the similarity from 0.92 on,
    and 0.1 for a shared album; settled pairs (a, b) are not proposed again.
    """
    key = organisation_key(F.col("name"))
    head = F.element_at(F.split(key, " "), 1)
    d = orgs.withColumn("key", key).filter("key <> ''")
    d = d.withColumn("_blocks", F.array_compact(F.array(F.concat(F.lit("full:"), "key"), F.when(F.length(head) > 2, F.concat(F.lit("head:"), head)))))
    d = d.withColumn("_also", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), organisation_key))
    pairs = without_settled(block_pairs(d, "id", "_blocks", most), settled)
    side = lambda x: d.select(F.col("id").alias(x), F.struct("key", "_also", "albums").alias(f"_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    also = F.concat(F.col("_a._also"), F.col("_b._also"))
    same = F.col("_a.key") == F.col("_b.key")
    like = S.jaro_winkler(F.col("_a.key"), F.col("_b.key"))
    p = p.withColumn("_jw", like)
    score = (
        F.when(same, 0.6).otherwise(0.0)
        + F.when(F.array_contains(also, F.col("_a.key")) | F.array_contains(also, F.col("_b.key")), 0.3).otherwise(0.0)
        + F.when(~same & (F.col("_jw") >= 0.92), F.round(0.1 * F.col("_jw"), 4)).otherwise(0.0)
        + F.when(F.coalesce(F.arrays_overlap(F.col("_a.albums"), F.col("_b.albums")), F.lit(False)), 0.1).otherwise(0.0)
    )
    p = p.withColumn("score", F.round(F.least(score, F.lit(1.0)), 4)).filter(F.col("score") >= least)
    return p.select("a", "b", "score", F.when(F.col("score") >= STRONG, 3).otherwise(6).alias("priority"))


def fuzzy_candidates(cases: DataFrame, names: DataFrame, least: float = 0.72, top: int = 3, length: tuple[int, int] = (4, 80)) -> DataFrame:
    """case_id, name_id, score, place: the `top` names whose trigrams agree with a case's to `least` (Dice) or more.

    cases: case_id, key; names: name_id, key.  Keys of cases shorter or longer
    than `length` have no candidates; a name of several keys counts with its best.
    """
    left = cases.filter(F.length("key").between(*length)).select(F.col("case_id").alias("a"), "key")
    p = gram_pairs(left, names.select(F.col("name_id").alias("b"), "key"), least)
    p = p.groupBy(F.col("a").alias("case_id"), F.col("b").alias("name_id")).agg(F.max("dice").alias("score"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "name_id")
    return p.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).withColumn("score", F.round("score", 6))


def curation_queue(flagged: DataFrame, unclassified: DataFrame, log: DataFrame) -> DataFrame:
    """kind, entity_id, categories, tier of what waits for curation, most urgent tier first.

    flagged: kind, entity_id, category, radio, n_tracks, a row per flag;
    unclassified: the same without category; log: kind, entity_id, id, action.
    What has no class waits unless it is flagged already or its latest entry in
    the log sets it aside as insufficient evidence.
    """
    key = ["kind", "entity_id"]
    facts = [F.bool_or("radio").alias("radio"), F.max("n_tracks").alias("n_tracks")]
    flags = flagged.groupBy(*key).agg(F.array_sort(F.collect_set("category")).alias("categories"), *facts)
    aside = log.filter(F.col("action").isin("insufficient_evidence", "reopen")).groupBy(*key).agg(F.max_by("action", "id").alias("_a")).filter("_a = 'insufficient_evidence'")
    rest = unclassified.join(flagged.select(*key), key, "left_anti").join(aside, key, "left_anti")
    rest = rest.groupBy(*key).agg(F.array(F.lit("unclassified")).alias("categories"), *facts)
    album = F.col("kind") == "album"
    tier = (
        F.when(album & F.col("radio"), 1)
        .when(~album & F.col("radio"), 2)
        .when(F.arrays_overlap("categories", F.array(F.lit("disagreement"), F.lit("contradiction"))), 3)
        .when(album & (F.col("n_tracks") > 0), 4)
        .otherwise(5)
    )
    return flags.unionByName(rest).select(*key, "categories", tier.alias("tier"))


def knowledge_units(annotations: DataFrame, known: DataFrame) -> DataFrame:
    """unit_key, annotation_id, blockers of annotations that are no unit yet.

    annotations: resource, source, capture, extractor, schema, annotation_id;
    reference (resolution of what it compares with, null for none), axis (of
    what it proposes, null for none), object (resolution), state, basis,
    coverage, method.  known: unit_key.  A capture that comes again makes no new
    units; an editor decides in any case.
    """
    parts = ["resource", "source", "capture", "extractor", "schema", "annotation_id"]
    key = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in parts])), 256)
    why = {
        "comparison_reference_unresolved": F.col("reference").isNotNull() & ~F.col("reference").isin("resolved", "external"),
        "evaluation_only_no_attribute": F.col("axis").isNull(),
        "identity_unresolved": ~F.col("object").eqNullSafe("resolved"),
        "assertion_requires_review": ~F.coalesce(F.col("state").isin("affirmed", "negated"), F.lit(False)),
        "activity_without_specific_evidence": (F.col("axis") == "activity") & ~F.coalesce(F.col("basis").isin("declared_use", "explicit_recommendation"), F.lit(False)),
        "absence_without_scope_coverage": (F.col("state") == "negated") & ~F.col("coverage").eqNullSafe("complete"),
        "energy_method_required": (F.col("axis") == "energy") & ~F.col("method").eqNullSafe("perceived-energy-v1"),
        "editorial_decision_required": F.lit(True),
    }
    blockers = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in why.items()]))
    d = annotations.withColumn("unit_key", key).join(known.select("unit_key"), "unit_key", "left_anti")
    return d.dropDuplicates(["unit_key"]).select("unit_key", "annotation_id", blockers.alias("blockers"))
