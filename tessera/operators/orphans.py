"""References to records that are missing, withdrawn or arrive later, per table and period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import pick
from tessera.functions.timebuckets import integer_div
from tessera.storage import Workspace


def references(df: DataFrame, table_name: str, key: str, seen_at: str) -> DataFrame:
    """Child keys in long form: (table_name, key, at). Null and empty keys refer to nothing."""
    return pick(df, key, seen_at).select(F.lit(table_name).alias("table_name"), F.col(f"`{key}`").alias("key"), F.col(f"`{seen_at}`").alias("at")).filter("key != ''")


#: Widths of the nested time cells in microseconds: days, ten minutes, seconds, instants.
CELLS = (86_400_000_000, 600_000_000, 1_000_000, 1)


def _judged(refs: DataFrame, loads: DataFrame, outer: list[str], width: int) -> DataFrame:
    """One row per table, outer cell, month and cell of ``width`` with its ``orphan_kind``, 'mixed' where a parent record cuts the cell.

    Children and parents are folded into cells first; a window over the cells of one key and outer cell then
    carries the parent state forward. ``before`` is the state in which the outer cell begins, ``known`` whether the key has a parent."""
    cell = lambda t: integer_div(F.unix_micros(t.cast("timestamp")), width)
    cells = refs.groupBy("table_name", *outer, F.date_format("at", "yyyy-MM").alias("ref_month"), cell(F.col("at")).alias("cell")).agg(
        F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.first("before").alias("before"), F.first("known").alias("known")
    )
    events = loads.groupBy(*outer, cell(F.col("at")).alias("cell")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.struct("at", "gone")).alias("last"))
    tagged = cells.withColumn("is_parent", F.lit(False)).unionByName(
        events.select(*outer, "cell", F.lit(True).alias("is_parent"), "first_at", "last_at", F.when(F.col("last_at").isNotNull(), F.col("last.gone")).alias("gone")),
        allowMissingColumns=True,
    )
    whole = Window.partitionBy(*outer)
    earlier = whole.orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*outer, "cell")
    placed = (
        tagged.withColumn("has_parent", F.max("is_parent").over(whole))
        .withColumn("carried", F.last("gone", ignorenulls=True).over(earlier))
        .withColumn("from_at", F.max("first_at").over(within))
        .withColumn("until_at", F.max("last_at").over(within))
        .withColumn("after", F.max("gone").over(within))
        .filter("not is_parent")
    )
    carried = F.coalesce("carried", "before")
    state = (
        F.when(~(F.col("has_parent") | F.col("known")), "missing")
        .when(F.col("cell").isNull(), "late")
        .when(F.col("from_at").isNull() | (F.col("from_at") > F.col("high")), _kind(carried))
        .when(F.col("until_at") <= F.col("low"), _kind(F.col("after")))
        .otherwise("mixed")
    )
    return placed.select("table_name", *outer, "ref_month", "cell", carried.alias("carried"), "n", state.alias("orphan_kind"))


def orphan_references(children: list[DataFrame], parents: DataFrame, key: str, loaded_at: str, is_removed: str, widths: tuple[int, ...] = CELLS) -> DataFrame:
    """(table_name, ref_month, key, orphan_kind, n_refs): references without a valid parent when seen.

    ``missing``: no parent record has the key. ``late``: none was loaded by then. ``removed``: the newest
    one loaded by then withdraws the key; of several loaded at the same instant one that withdraws wins,
    and a null flag doesn't withdraw. Parent records without a time only prove that the key exists.
    References without a time count in a null month, as missing or else late: no record is known to be
    loaded by then.

    Method: parent and child keys are tagged and united in long form and grouped by key. Both are first
    folded into cells (key, day), so what is shuffled by key is at most one row per day and table, and a
    hot key is no hot group. A window over a key's days carries the parent state forward. A day with no
    parent record between its first and last reference has one answer for all of them. Days that a parent
    record cuts are folded again into ten minutes, those into seconds and those into instants, which
    nothing cuts. So however many references or records a key has on one day, a window holds at most one
    row per cell of the next width and table.
    """
    if widths[-1] != 1:
        raise ValueError("the last width must be an instant")
    space = Workspace(parents.sparkSession, "orphans")
    refs = reduce(DataFrame.unionByName, children).withColumn("before", F.lit(None).cast("boolean")).withColumn("known", F.lit(False))
    loads = pick(parents, key, loaded_at, is_removed).select(F.col(f"`{key}`").alias("key"), F.col(f"`{loaded_at}`").alias("at"), F.coalesce(F.col(f"`{is_removed}`"), F.lit(False)).alias("gone")).filter("key is not null")
    outer, found = ["key"], []
    for i, width in enumerate(widths):
        judged = space.save(_judged(refs, loads, outer, width), f"cells-{i}")
        found.append(judged.filter("orphan_kind not in ('mixed', 'valid')").select("table_name", "ref_month", "key", "orphan_kind", "n"))
        mixed = space.save(judged.filter("orphan_kind = 'mixed'").select("table_name", "key", "cell", "carried").distinct(), f"mixed-{i}")
        if mixed.isEmpty():
            break
        cell = integer_div(F.unix_micros(F.col("at").cast("timestamp")), width)
        # both sides of these joins are read from tables, so the rows of a hot day are split
        again = refs.select("table_name", "key", "at", cell.alias("cell")).join(mixed, ["table_name", "key", "cell"])
        refs = space.save(again.select("table_name", "key", "at", F.col("cell").alias("outer"), F.col("carried").alias("before"), F.lit(True).alias("known")), f"refs-{i}")
        cut = loads.select("key", "at", "gone", cell.alias("cell")).join(mixed.select("key", "cell").distinct(), ["key", "cell"], "left_semi")
        loads = space.save(cut.select("key", "at", "gone", F.col("cell").alias("outer")), f"loads-{i}")
        outer = ["key", "outer"]
    return reduce(DataFrame.unionByName, found).groupBy("table_name", "ref_month", "key", "orphan_kind").agg(F.sum("n").alias("n_refs"))


def _kind(gone: Column) -> Column:
    return F.when(gone.isNull(), "late").when(gone, "removed").otherwise("valid")
