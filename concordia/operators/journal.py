"""Change data: row diffs, net changes, undo plans and deltas of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, op (I, U, D), old_data, new_data as maps of the columns that differ; rows without a difference make none."""
    text = lambda side: F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(f"{side}.{v}").cast("string") for v in values]))
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    d = o.join(n, list(keys), "full")
    op = F.when(F.col("_o").isNull(), "I").when(F.col("_n").isNull(), "D").when(~F.col("_o").eqNullSafe(F.col("_n")), "U")
    d = d.withColumn("op", op).filter("op is not null").withColumn("_om", text("_o")).withColumn("_nm", text("_n"))
    keep = lambda a, b: F.map_filter(a, lambda k, v: ~v.eqNullSafe(b[k]))
    return d.select(
        *keys,
        "op",
        F.when(F.col("op") == "U", keep(F.col("_om"), F.col("_nm"))).when(F.col("op") == "D", F.col("_om")).alias("old_data"),
        F.when(F.col("op") == "U", keep(F.col("_nm"), F.col("_om"))).when(F.col("op") == "I", F.col("_nm")).alias("new_data"),
    )


def net_changes(journal: DataFrame) -> DataFrame:
    """table_name, row_pk, existed_before, exists_after, before, after, step of a journal (id, table_name, op, row_pk, old_data, new_data as maps).

    before holds the first old value per column, after the last new one; rows
    that neither existed before nor exist after drop out.
    """
    w = Window.partitionBy("table_name", "row_pk").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = journal.withColumn("_first", F.first("op").over(whole)).withColumn("_last", F.last("op").over(whole))
    rows = d.select("table_name", "row_pk", (F.col("_first") != "I").alias("existed_before"), (F.col("_last") != "D").alias("exists_after")).distinct()

    def side(data: str, best, name: str) -> DataFrame:
        cells = journal.select("id", "table_name", "row_pk", F.explode(data).alias("col", "val"))
        one = cells.groupBy("table_name", "row_pk", "col").agg(best(F.struct("val"), F.col("id")).alias("v"))
        return one.groupBy("table_name", "row_pk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", F.col("v.val"))))).alias(name))

    before, after = side("old_data", F.min_by, "before"), side("new_data", F.max_by, "after")
    d = rows.join(before, ["table_name", "row_pk"], "left").join(after, ["table_name", "row_pk"], "left")
    d = d.filter("existed_before or exists_after")
    step = F.when(~F.col("existed_before"), "remove").when(~F.col("exists_after"), "restore").otherwise("revert")
    return d.withColumn("before", F.when(F.col("existed_before"), F.col("before"))).withColumn("after", F.when(F.col("exists_after"), F.col("after"))).withColumn("step", step)


def undo_plan(journal: DataFrame, run: int | str) -> DataFrame:
    """The net changes of a run, each blocked if another run changed the row later."""
    own = journal.filter(F.col("run_id") == run)
    last = own.groupBy("table_name", "row_pk").agg(F.max("id").alias("_last"))
    rest = journal.filter(~F.col("run_id").eqNullSafe(F.lit(run))).select("table_name", "row_pk", "id")
    later = last.join(rest, ["table_name", "row_pk"]).filter("id > _last").select("table_name", "row_pk").distinct().withColumn("_b", F.lit(True))
    return net_changes(own).join(later, ["table_name", "row_pk"], "left").withColumn("blocked", F.coalesce("_b", F.lit(False))).drop("_b")


def run_summary(journal: DataFrame, first: int = 8) -> DataFrame:
    """run_id, table_name, inserted, updated, deleted, entities, first_entities."""
    one = lambda op: F.count_if(F.col("op") == op)
    g = journal.groupBy("run_id", "table_name").agg(one("I").alias("inserted"), one("U").alias("updated"), one("D").alias("deleted"), F.countDistinct("row_pk").alias("entities"))
    w = Window.partitionBy("run_id", "table_name").orderBy("id")
    seen = journal.groupBy("run_id", "table_name", "row_pk").agg(F.min("id").alias("id"))
    top = seen.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first)
    names = top.groupBy("run_id", "table_name").agg(F.sort_array(F.collect_list(F.struct("id", "row_pk")))["row_pk"].alias("first_entities"))
    return g.join(names, ["run_id", "table_name"])


def findings_delta(old: DataFrame, new: DataFrame, seen_by: Sequence[str] | None = None) -> DataFrame:
    """fingerprint, change (new, reopened, changed, unchanged, resolved) between stored and fresh findings.

    old: fingerprint, content_hash, status; new: fingerprint, content_hash.
    """
    o = old.select("fingerprint", F.col("content_hash").alias("_oh"), "status")
    n = new.select("fingerprint", F.col("content_hash").alias("_nh"))
    d = o.join(n, "fingerprint", "full")
    change = (
        F.when(F.col("_oh").isNull(), "new")
        .when(F.col("_nh").isNull(), F.when(F.col("status") == "resolved", "gone").otherwise("resolved"))
        .when(F.col("status") == "resolved", "reopened")
        .when(F.col("_oh") != F.col("_nh"), "changed")
        .otherwise("unchanged")
    )
    return d.select("fingerprint", change.alias("change"))


def bounded_history(history, entry, most: int = 5):
    """The newest entries of an array column, the new one first."""
    return F.slice(F.concat(F.array(entry), F.coalesce(history, F.array().cast("array<string>"))), 1, most)
