"""One ranking from several scores of different scale: robust rank aggregation.

Only ranks enter (Kolde et al., Robust rank aggregation, 2012): per score each item gets the share of
items at or above it; an item's shares are sorted, and the k-th of m is compared with the k-th order
statistic of m uniform numbers, whose distribution is a beta. The least of these probabilities times m
(the correction for taking the least) is the item's significance, by which items are ranked.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import pick
from tessera.storage import Workspace

#: With more scores the least possible significance, rows to the power of minus scores, may be no double.
MAX_SCORES = 16


def complete_rows(items: DataFrame, id_column: str, scores: list[str]) -> DataFrame:
    """The id and scores of the rows, distinct over all columns, in which no score is null or NaN."""
    rows = pick(items.distinct(), id_column, *scores)
    for s in scores:
        rows = rows.filter(F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")))
    return rows


def _keys(score: Column, integral: bool) -> list[Column]:
    """A score as a double and, where it is of an integer type, exactly: beyond 2^53 doubles tie what integers tell apart."""
    return [score.cast("double").alias("value"), (score.cast("bigint") if integral else F.lit(0).cast("bigint")).alias("exact")]


def _integral(rows: DataFrame, scores: list[str]) -> list[bool]:
    return [rows.schema[s].dataType.typeName() in ("byte", "short", "integer", "long") for s in scores]


def higher_counts(rows: DataFrame, scores: list[str], values_per_slice: int = 500_000) -> DataFrame:
    """(score, value, exact, higher): for each value of each score, how many rows have a strictly higher one.

    Exact and without a global sort in one task: equal values are counted first, so ties cost one row;
    the values are range-partitioned and written, so every file covers one range; the totals of the
    ranges, one row per file and score, give each range its offset. The number of ranges follows from
    the number of distinct values, so no window holds many more than ``values_per_slice`` rows."""
    space = Workspace(rows.sparkSession, "ranks")
    kinds = _integral(rows, scores)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("score"), *_keys(F.col(s), k)) for i, (s, k) in enumerate(zip(scores, kinds))])).alias("r")).select("r.*")
    counts = space.save(long.groupBy("score", "value", "exact").agg(F.count("*").alias("n")), "counts")
    slices = max(1, -(-counts.count() // values_per_slice))
    down = [F.desc("value"), F.desc("exact")]
    ranged = space.save(counts.repartitionByRange(slices, "score", *down).withColumn("slice", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("score", "slice").agg(F.sum("n").alias("total"), F.max(F.struct("value", "exact")).alias("top"))
    # the ranges are at most ``slices`` plus one per score, so this window is over a small table
    above = Window.partitionBy("score").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(above), F.lit(0))).select("score", "slice", "offset")
    inside = Window.partitionBy("score", "slice").orderBy(*down).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, ["score", "slice"]).select("score", "value", "exact", (F.col("before") + F.col("offset")).alias("higher"))


def _power(x: Column, k: int) -> Column:
    return reduce(lambda a, b: a * b, [x] * k, F.lit(1.0))


def beta_order_statistic(x: Column, k: int, m: int) -> Column:
    """Probability that the k-th smallest of m uniform numbers is at most x: a binomial tail, in sums and products only."""
    terms = [F.lit(float(comb(m, j))) * _power(x, j) * _power(1 - x, m - j) for j in range(k, m + 1)]
    return reduce(lambda a, b: a + b, terms)


def ranked_items(items: DataFrame, id_column: str, scores: list[str], values_per_slice: int = 500_000) -> DataFrame:
    """Id and scores of the complete distinct rows with, per score s, ``s_higher`` (rows strictly above), and ``n_rows``,
    ``significance`` and ``place``.

    Higher scores are better. Tied values share the worst case for none: each gets (rows above + 1) / n.
    ``significance`` is at most 1 and not rounded; equal significances share a place, as in a competition.
    At most MAX_SCORES scores can be combined, so that no significance falls below the least double.
    Rows with a null or NaN score aren't ranked; a null id is an id like others; an empty table gives an
    empty result. Other columns only count in telling rows apart.
    """
    m = len(scores)
    if not 1 <= m <= MAX_SCORES:
        raise ValueError(f"1 to {MAX_SCORES} scores can be combined")
    space = Workspace(items.sparkSession, "ranking")
    rows = space.save(complete_rows(items, id_column, scores), "rows")
    n = rows.count()
    counts = space.save(higher_counts(rows, scores, values_per_slice), "higher")
    out = rows
    for i, (s, k) in enumerate(zip(scores, _integral(rows, scores))):
        one = counts.filter(F.col("score") == i).select(F.col("value").alias("_v"), F.col("exact").alias("_e"), F.col("higher").alias(f"{s}_higher"))
        value, exact = _keys(F.col(s), k)
        out = out.join(one, (value == F.col("_v")) & (exact == F.col("_e"))).drop("_v", "_e")
    ranks = F.array_sort(F.array(*[(F.col(f"{s}_higher") + 1) / F.lit(float(max(n, 1))) for s in scores]))
    out = out.withColumn("_r", ranks)
    tails = [beta_order_statistic(F.get("_r", k - 1), k, m) for k in range(1, m + 1)]
    least = F.least(*tails) if m > 1 else tails[0]
    out = space.save(out.withColumn("significance", F.least(F.lit(1.0), least * m)).drop("_r").withColumn("n_rows", F.lit(n)), "scored")
    worse = higher_counts(out.select((-F.col("significance")).alias("s")), ["s"], values_per_slice)
    return out.join(worse.select((-F.col("value")).alias("significance"), (F.col("higher") + 1).alias("place")), "significance")


def leading_items(ranked: DataFrame, scores: list[str], share: int = 10) -> DataFrame:
    """Items with fewer than n / ``share`` rows strictly above them in each score, found through their significance.

    All m ranks of such an item are below 1 / share + 1 / n, so the m-th order statistic alone makes its
    significance less than m times that bound to the power m. Only items as significant as that are
    compared with the definition itself."""
    m, n = len(scores), F.col("n_rows")
    bound = m * _power(1.0 / share + 1.0 / n, m) * (1 + 1e-9)
    test = reduce(lambda a, b: a & b, [F.col(f"{s}_higher") * share < n for s in scores])
    return ranked.filter(F.col("significance") <= bound).filter(test)
