"""The same ingest as a stream: new review files become cleaned rows in a Parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.timebuckets import time_bucket
from tessera.operators.reviews import cleaned_reviews, valid_reviews
from tessera.sources.jsonl import REVIEW_FIELDS, review_records


def stream_reviews(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Valid, cleaned reviews of files as they arrive; streams need the schema beforehand."""
    known = T.StructType([f for f in schema.fields if f.name in REVIEW_FIELDS])
    return cleaned_reviews(valid_reviews(review_records(spark.readStream.schema(known).json(path))))


def stream_group_counts(reviews: DataFrame, hours: int = 24) -> DataFrame:
    """Running number of reviews per product and bucket, for the output modes update and complete."""
    return reviews.groupBy("product_id", time_bucket(F.col("timestamp"), hours).alias("bucket")).agg(F.count("*").alias("group_rows"))


def write_reviews(reviews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once, process what is there and stop."""
    return reviews.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
