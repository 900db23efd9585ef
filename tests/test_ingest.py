import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import clean_text
from tessera.functions.timebuckets import time_bucket, to_seconds
from tessera.operators import reviews
from tessera.sources.jsonl import read_metadata, read_reviews


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_aliases_and_malformed_lines(spark, tmp_path):
    full = {"user_id": "u", "parent_asin": "p", "text": "t", "rating": 4, "timestamp": 5, "verified_purchase": True, "helpful_vote": 3}
    other = {"user": "u", "asin": "p", "reviewText": "t", "rating": 4.0, "timestamp": 5, "verifiedPurchase": True, "helpful_vote": 0, "helpful_votes": 3, "User_ID": "x"}
    at = write(tmp_path / "r.jsonl", [full, other, '{"user_id": "cut', {"user_id": "", "product_id": "q", "timestamp": 7}])
    rows = reviews.valid_reviews(read_reviews(spark, at)).collect()
    assert len(rows) == 3
    assert rows[0] == rows[1]
    assert rows[2].user_id == "" and rows[2].rating == 0.0 and rows[2].helpful_votes == 0 and rows[2].verified_purchase is False


@pytest.mark.parametrize(
    "value,seconds",
    [("1.5", None), (" 12 ", None), ("+5", 5), ("12", 12), (0, None), (-5, None), (100000000000, 100000000000), (100000000001, 100000000), (2.9, 2), (None, None)],
)
def test_timestamps(spark, tmp_path, value, seconds):
    at = write(tmp_path / "r.jsonl", [{"user_id": "u", "asin": "p", "timestamp": value}])
    rows = reviews.valid_reviews(read_reviews(spark, at)).collect()
    assert [r.timestamp for r in rows] == ([] if seconds is None else [seconds])


@pytest.mark.parametrize("value,expected", [("TRUE", True), ("t", False), (1, False), (True, True), (None, False)])
def test_flags(spark, tmp_path, value, expected):
    at = write(tmp_path / "r.jsonl", [{"user_id": "u", "verified_purchase": value}])
    assert read_reviews(spark, at).first().verified_purchase is expected


def test_numbers_as_text_and_out_of_range(spark, tmp_path):
    at = write(tmp_path / "r.jsonl", [{"user_id": "u", "rating": "3.0d", "helpful_vote": 5000000000}, {"user_id": "v", "rating": "x"}])
    a, b = read_reviews(spark, at).collect()
    assert (a.rating, a.helpful_votes, b.rating) == (3.0, 0, 0.0)


def test_duplicate_metadata_multiplies_unless_deduplicated(spark, tmp_path):
    r = write(tmp_path / "r.jsonl", [{"user_id": "u", "asin": "p", "timestamp": 9}, {"user_id": "u", "asin": "none", "timestamp": 9}])
    m = write(tmp_path / "m.jsonl", [{"asin": "p", "title": "a"}, {"asin": "p", "title": "b"}, {"title": "no key"}])
    left, right = reviews.valid_reviews(read_reviews(spark, r)), reviews.valid_metadata(read_metadata(spark, m))
    assert reviews.enrich(left, right).count() == 2
    kept = reviews.enrich(left, right, dedup_metadata=True).collect()
    assert [x.product_title for x in kept] == ["a"]


def test_clean_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("  A-b\x0b\tÇ9 ",), ("!!",), ("x" * 200_000,)], "t string")
    assert [r.c if len(r.c) < 50 else len(r.c) for r in df.select(clean_text(F.col("t")).alias("c")).collect()] == ["", "", "a b 9", "", 200_000]


def test_buckets(spark):
    df = spark.createDataFrame([(86399,), (86400,), (100000000000,), (100000000001,)], "t bigint")
    rows = df.select(to_seconds(F.col("t")).alias("s")).select("s", time_bucket(F.col("s"), 24).alias("d"), time_bucket(F.col("s"), 6).alias("q")).collect()
    assert [(r.s, r.d, r.q) for r in rows] == [(86399, 0, 3), (86400, 1, 4), (100000000000, 1157407, 4629629), (100000000, 1157, 4629)]
