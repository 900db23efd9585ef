"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.functions.timebuckets import time_bucket, to_seconds


def keyed_aggregate(df: DataFrame, keys: list[str], *aggregates: Column, distinct: str | None = None) -> DataFrame:
    """Group results by map-side combining: every task folds its rows into a hash table of partial
    states, which spills when memory runs out, and only those states are shuffled.

    ``aggregates`` are built-in aggregates whose states have a fixed size (count, sum, min, max, avg),
    so a key costs one small row per task however many rows it holds. ``distinct`` adds an exact
    ``n_<column>``: the pairs of key and value are grouped first, by pair, so a hot key's values
    are spread over all tasks; what reaches the key's own task is again one partial count per task.
    Null keys form their own group, as in SQL.
    """
    out = df.groupBy(*keys).agg(*aggregates)
    if distinct is None:
        return out
    values = df.filter(F.col(distinct).isNotNull()).select(*keys, distinct).distinct()
    counted = values.groupBy(*keys).agg(F.count("*").alias("n"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for test in same[1:]:
        on = on & test
    return out.alias("o").join(counted.alias("c"), on, "left").select("o.*", F.coalesce("c.n", F.lit(0)).alias(f"n_{distinct}"))


def product_days(reviews: DataFrame, hours: int = 24, columns: tuple[str, ...] = ()) -> DataFrame:
    """Reviews with a product key and a positive time: ``columns``, ``seconds`` and the number of the time bucket.

    Null and empty product ids are no keys; null, zero and negative times have no bucket."""
    reviews = pick(reviews, "product_id", "timestamp", *columns)
    timed = reviews.withColumn("seconds", to_seconds(F.col("timestamp"))).filter((F.col("product_id") != "") & (F.col("seconds") > 0))
    return timed.withColumn("bucket", time_bucket(F.col("seconds"), hours))


def group_results(reviews: DataFrame, hours: int = 24) -> DataFrame:
    """Per product and bucket: rows, distinct users, first and last time, rating sum and votes. Repeated rows count.

    Ratings are summed to ten decimals, so the sum doesn't depend on the order in which tasks finish."""
    return keyed_aggregate(
        product_days(reviews, hours, ("user_id", "rating", "helpful_votes")),
        ["product_id", "bucket"],
        F.count("*").alias("group_rows"),
        F.min("seconds").alias("first_seen"),
        F.max("seconds").alias("last_seen"),
        F.sum(F.col("rating").cast("decimal(28,10)")).cast("double").alias("rating_sum"),
        F.sum("helpful_votes").alias("votes"),
        distinct="user_id",
    )


def large_groups(reviews: DataFrame, above: int = 40, hours: int = 24) -> DataFrame:
    """(product_id, bucket) of the groups of more than ``above`` rows."""
    counted = keyed_aggregate(product_days(reviews, hours).select("product_id", "bucket"), ["product_id", "bucket"], F.count("*").alias("n"))
    return counted.filter(F.col("n") > above).select("product_id", "bucket")
