"""The test tables seen as reviews and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.timebuckets import integer_div
from tessera.storage import Workspace


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp column."""
    return integer_div(F.unix_micros(ts.cast("timestamp")), 1_000_000)


def orders_brand(spark: SparkSession, folder: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Customers as users, brands as products, order dates as times.

    ``part`` (i, n): the i-th of n parts, by a hash of the order. Spark infers the same filter for the orders."""
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    if part[1] > 1:
        lineitem = lineitem.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(part[1])) == part[0])
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(part, lineitem.l_partkey == part.p_partkey)
        .select(F.col("o_custkey").cast("string").alias("user_id"), F.col("p_brand").alias("product_id"), epoch(F.col("o_orderdate")).alias("timestamp"))
    )


def orders_reviews(spark: SparkSession, folder: str, space: Workspace | None = None) -> DataFrame:
    """The same with all seven review columns, one row per line item.

    With ``space`` the first join is written to it, so that the shuffles of the two joins aren't on disk together."""
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    ordered = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).drop("l_orderkey", "o_orderkey")
    if space is not None:
        ordered = space.save(ordered, "ordered")
        space.release()
    return (
        ordered.join(part, ordered.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("p_brand").alias("product_id"),
            F.col("l_quantity").alias("rating"),
            epoch(F.col("o_orderdate")).alias("timestamp"),
            F.concat_ws(" - ", "p_name", "o_orderpriority").alias("review_text"),
            (F.col("l_returnflag") == "R").alias("verified_purchase"),
            F.col("l_linenumber").alias("helpful_votes"),
        )
    )


def brand_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One metadata record per brand."""
    return (
        table(spark, folder, "part")
        .groupBy(F.col("p_brand").alias("product_id"))
        .agg(F.min("p_type").alias("category"), F.min("p_name").alias("product_title"), F.max("p_retailprice").alias("catalog_average_rating"))
    )


def events_type(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as products."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("product_id"), epoch(F.col("ts")).alias("timestamp")
    )


def events_key(spark: SparkSession, folder: str) -> DataFrame:
    """The key in the event's properties as product."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("product_id"), epoch(F.col("ts")).alias("timestamp")
    )
