"""Time groups of a product, with the one-step split of oversized groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PipelineConfig
from tessera.functions.timebuckets import time_bucket
from tessera.storage import Workspace


def group_sizes(enriched: DataFrame, hours: int) -> DataFrame:
    """Rows per product and time bucket. Counts are combined before the shuffle, so a hot key costs one row per task."""
    return (
        enriched.select("product_id", time_bucket(F.col("timestamp"), hours).alias("bucket"))
        .groupBy("product_id", "bucket")
        .agg(F.count("*").alias("group_rows"))
    )


def user_round(rounds: int) -> Column:
    """In which of the rounds a user is, by a hash."""
    return F.pmod(F.xxhash64("user_id"), F.lit(rounds)).cast("int").alias("round")


def candidate_groups(enriched: DataFrame | list[DataFrame], config: PipelineConfig = PipelineConfig(), space: Workspace | None = None, rounds: int = 1) -> DataFrame:
    """(user_id, product_id, bucket) per row.

    A group of more than ``oversized_group_limit`` rows moves to the smaller buckets, once; repeated
    rows count. The bucket number carries no width, so equal numbers of either width share a group.
    The rows are written once with both of their buckets, so what joins them runs once. Sizes come from a
    partial aggregate, and the oversized keys are written before they are joined back: a small table is then
    broadcast by its size on disk, and otherwise both sides of the join are plain shuffles, which the adaptive
    planner splits where one group holds very many rows.

    A list holds parts of the rows, which are written one after another, so that only one part's shuffles
    are on disk at a time. ``space`` is where the result is read from. With more than one of ``rounds`` the result has
    a column ``round``, of users by a hash, and a filter on it reads only the rows of that round.
    """
    parts = enriched if isinstance(enriched, list) else [enriched]
    space = space or Workspace(parts[0].sparkSession, "oversized")
    own = [user_round(rounds)] if rounds > 1 else []
    bucketed = [
        part.select(
            "user_id",
            "product_id",
            time_bucket(F.col("timestamp"), config.initial_bucket_hours).alias("wide"),
            time_bucket(F.col("timestamp"), config.small_bucket_hours).alias("narrow"),
            *own,
        )
        for part in parts
    ]
    rows = space.save_rounds(bucketed, "rows", ["round"] if own else [])
    sized = rows.groupBy("product_id", "wide").agg(F.count("*").alias("group_rows")).filter(F.col("group_rows") > config.oversized_group_limit)
    big = space.save(sized.select("product_id", "wide", F.lit(True).alias("oversized")), "groups")
    return rows.join(big, ["product_id", "wide"], "left").select(
        "user_id", "product_id", F.when(F.col("oversized"), F.col("narrow")).otherwise(F.col("wide")).alias("bucket"), *(["round"] if own else [])
    )
