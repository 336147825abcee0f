"""Pairs of persons that may be one: signatures, nicknames, shared work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import similarity as S
from ..functions import text as T
from ..functions.similarity import _osa
from .resolution import block_pairs, without_settled
from .review import ORGANISATION_WORDS, PROPOSED, STRONG

NICKNAME = r"[\"“”«»][^\"“”«»]*[\"“”«»]|\([^)]*\)"

# Given names that a familiar form may stand for.
FAMILIAR = {
    "beto": ["alberto", "roberto", "humberto", "norberto", "heriberto", "gilberto"], "pepe": ["jose"], "cheo": ["jose"], "joseito": ["jose"], "chema": ["jose"], "pepito": ["jose"],
    "chucho": ["jesus"], "chuy": ["jesus"], "chui": ["jesus"], "chuo": ["jesus"], "kike": ["enrique"], "quique": ["enrique"], "kiko": ["enrique", "francisco"],
    "paco": ["francisco"], "pancho": ["francisco"], "pacho": ["francisco"], "frank": ["francisco", "franklin"], "manolo": ["manuel"], "manel": ["manuel"], "lolo": ["manuel"],
    "tono": ["antonio"], "tony": ["antonio"], "toni": ["antonio"], "nacho": ["ignacio"], "lalo": ["eduardo"], "edu": ["eduardo"], "memo": ["guillermo"],
    "willy": ["william", "guillermo"], "rafa": ["rafael"], "santi": ["santiago"], "alex": ["alejandro", "alexander", "alexis"], "ale": ["alejandro"], "alejo": ["alejandro"],
    "richi": ["ricardo"], "richie": ["ricardo"], "ricky": ["ricardo", "enrique"], "nando": ["fernando", "hernando"], "fer": ["fernando"], "gaby": ["gabriel"], "gabo": ["gabriel"],
    "lucho": ["luis"], "licho": ["luis"], "nico": ["nicolas"], "juancho": ["juan"], "charlie": ["carlos"], "charly": ["carlos"], "carlitos": ["carlos"], "mike": ["miguel"], "migue": ["miguel"],
    "tavo": ["gustavo", "octavio"], "gus": ["gustavo"], "dani": ["daniel"], "freddy": ["alfredo", "federico"], "bobby": ["roberto"], "johnny": ["juan", "jonathan"],
    "jhonny": ["juan", "jonathan"], "poncho": ["alfonso"], "sebas": ["sebastian"], "javi": ["javier"], "goyo": ["gregorio"], "moncho": ["ramon"], "rulo": ["raul"],
}


def plain_name(name: Column) -> Column:
    """The key of a name without what stands in quotes or brackets."""
    return T.secondary_key(F.regexp_replace(name, NICKNAME, " "))


def _tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: F.length(w) > 1)


def signatures(names: Column) -> Column:
    """Distinct struct(first, last, nick) of an array of names: given name, or a nickname in its place, and surname."""

    def of(name: Column) -> Column:
        t = _tokens(plain_name(name))
        nicks = F.transform(F.regexp_extract_all(name, F.lit(f"({NICKNAME})"), F.lit(1)), lambda x: T.secondary_key(F.substr(x, F.lit(2), F.length(x) - 2)))
        nicks = F.filter(nicks, lambda x: x.rlike("^[a-z]{2,}$"))
        form = lambda first, nick: F.struct(first.alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"), F.lit(nick).alias("nick"))
        forms = F.concat(F.array(form(F.get(t, 0), False)), F.transform(nicks, lambda x: form(x, True)))
        return F.when(F.size(t) >= 2, forms).otherwise(F.filter(forms, lambda _: F.lit(False)))

    return F.array_distinct(F.flatten(F.transform(names, of)))


def block_keys(name: Column, forms: Column) -> Column:
    """The plain name, first and last word, and each signature's given name with either end of the surname."""
    familiar = F.create_map(*[x for k, v in FAMILIAR.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    base = plain_name(name)
    t = _tokens(base)
    given = lambda f: F.concat(F.array(f["first"]), F.coalesce(familiar[f["first"]], F.array().cast("array<string>")))
    ends = lambda f: F.array(F.substr(f["last"], F.lit(1), F.lit(3)), F.concat(F.lit("…"), F.right(f["last"], F.lit(3))))
    some = F.flatten(F.transform(forms, lambda f: F.flatten(F.transform(given(f), lambda g: F.transform(ends(f), lambda e: F.concat(F.lit("nv:"), g, F.lit("|"), e))))))
    whole = F.array(F.when(base != "", F.concat(F.lit("full:"), base)), F.when(F.size(t) >= 2, F.concat(F.lit("fl:"), F.get(t, 0), F.lit("|"), F.try_element_at(t, F.lit(-1)))))
    return F.concat(F.array_compact(whole), some)


def _surname(a: str, b: str) -> float:
    n = min(len(a), len(b))
    if a == b:
        return 0.2
    return 0.15 if n >= 5 and a[0] == b[0] and _osa(a, b) <= (2 if n > 7 else 1) else 0.0


def _given(a: tuple, b: tuple, same_surname: bool) -> float:
    x, y = a["first"], b["first"]
    if x != y:
        return 0.15 if y in FAMILIAR.get(x, ()) or x in FAMILIAR.get(y, ()) else 0.0
    if a["nick"] or b["nick"]:
        return 0.3
    return 0.0 if same_surname else 0.25


@F.pandas_udf(DoubleType())
def signature_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best agreement of two lists of signatures that differ: given name and surname both count, or neither."""

    def best(xs: list, ys: list) -> float:
        top = 0.0
        for x in xs:
            for y in ys:
                last = _surname(x["last"], y["last"])
                first = _given(x, y, x["last"] == y["last"]) if last else 0.0
                top = max(top, first + last if first else 0.0)
        return top

    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def person_pairs(persons: DataFrame, settled: DataFrame, least: float = PROPOSED, most: int = 25) -> DataFrame:
    """a < b, score, features, priority of persons that may be one, unless dates contradict or a name is an organisation's.

    persons: id, name, born, died, arrays aliases, bands, albums, artists,
    colleagues.  A block of more than `most` names is too common to tell
    anything; settled pairs (a, b) are not proposed again.
    """
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("name"), F.coalesce("aliases", empty))
    d = persons.filter("name is not null").filter(~F.col("name").rlike(ORGANISATION_WORDS)).withColumn("_forms", signatures(names))
    d = d.withColumn("_base", plain_name(F.col("name"))).withColumn("_key", T.secondary_key(F.col("name"))).withColumn("_t", _tokens(F.col("_base")))
    d = d.withColumn("_also", F.transform(F.coalesce("aliases", empty), T.secondary_key)).withColumn("_plain", F.transform(F.coalesce("aliases", empty), plain_name))
    pairs = without_settled(block_pairs(d.select("id", block_keys(F.col("name"), F.col("_forms")).alias("_blocks")), "id", "_blocks", most), settled)
    kept = ["born", "died", "bands", "albums", "artists", "colleagues", "_forms", "_base", "_key", "_t", "_also", "_plain"]
    side = lambda x: d.select(F.col("id").alias(x), F.struct(*kept).alias(f"_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    l, r = lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}")  # noqa: E731, E741
    p = p.filter(F.coalesce(l("born") == r("born"), F.lit(True)) & F.coalesce(l("died") == r("died"), F.lit(True)))
    p = p.withColumn("_jw", S.jaro_winkler(l("_base"), r("_base"))).withColumn("_sig", signature_score(l("_forms"), r("_forms")))
    common = lambda c: F.coalesce(F.size(F.array_intersect(l(c), r(c))), F.lit(0))
    nick = (l("_base") != "") & (l("_base") == r("_base")) & ((l("_base") != l("_key")) | (r("_base") != r("_key")))
    named = lambda x, y: F.array_contains(y("_also"), x("_key")) | F.array_contains(y("_plain"), x("_base"))
    cross = named(l, r) | named(r, l)
    both = lambda n: (F.size(l("_t")) >= n) & (F.size(r("_t")) >= n)
    ends = ~nick & both(2) & (F.get(l("_t"), 0) == F.get(r("_t"), 0)) & (F.try_element_at(l("_t"), F.lit(-1)) == F.try_element_at(r("_t"), F.lit(-1)))
    middle = lambda x: F.slice(x("_t"), 2, F.greatest(F.size(x("_t")) - 2, F.lit(0)))
    far = (common("bands") == 0) & (common("albums") == 0)
    worth = {
        "nickname_equal": (nick, F.lit(0.45)),
        "alias_cross": (cross, F.lit(0.45)),
        "first_last_equal": (ends, F.lit(0.25)),
        "jaro_winkler": (F.col("_jw") >= 0.92, 0.15 * F.col("_jw")),
        "name_variant": (~nick & ~cross & ~ends & (F.col("_sig") > 0), F.col("_sig")),
        "shared_band": (common("bands") > 0, F.lit(0.2)),
        "shared_album": (common("albums") > 0, F.lit(0.15)),
        "shared_artist": (far & (common("artists") > 0), F.lit(0.1)),
        "shared_colleagues": (far & (common("colleagues") >= 2), F.lit(0.1)),
        "middle_name_clash": (both(3) & (middle(l) != middle(r)), F.lit(-0.1)),
    }
    features = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), F.round(v, 4).alias("value"))) for k, (c, v) in worth.items()]))
    total = sum((F.when(c, v).otherwise(0.0) for c, v in worth.values()), F.lit(0.0))
    p = p.withColumn("features", features).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))
    return p.filter(F.col("score") >= least).select("a", "b", "score", "features", F.when(F.col("score") >= STRONG, 3).otherwise(6).alias("priority"))
