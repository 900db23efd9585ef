import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tessera.operators import drift, orphans, skew

LINES = "feed_name string, file_name string, file_seq int, line_no int, payload string, V string, n string"


def raw(spark, files):
    rows = [(f, f"{f}/{s}", s, i, p if isinstance(p, str) or p is None else json.dumps(p), "x", "y") for (f, s), lines in files.items() for i, p in enumerate(lines)]
    return spark.createDataFrame(rows, LINES)


def changes(df):
    return {(r.file_name, r.field_name, r.old_name, r.change_kind) for r in drift.schema_changes(df).collect()}


def test_renames_by_alternative_and_by_content(spark):
    text = lambda i: f"the {i} lamp fell from its shelf and broke in many pieces"
    one = [{"user_id": f"AB{i}QX{i}", "text": text(i), "mark": i % 5 + 1, "same": 1} for i in range(20)]
    two = [{"user": f"CD{i}QX{i}", "wording": text(i + 50), "flag": True, "same": "1"} for i in range(20)]
    got = changes(raw(spark, {("f", 1): one, ("f", 4): two}))
    assert got == {
        ("f/4", "user", "user_id", "renamed"),
        ("f/4", "wording", "text", "renamed"),
        ("f/4", "mark", None, "removed"),
        ("f/4", "flag", None, "added"),
        ("f/4", "same", None, "retyped"),
    }


def test_case_nulls_malformed_and_empty(spark):
    first = [{"a": None, "A": 1}, '{"a": 1} tail', '{"a": 1}{"b": 2}', "", None, "[1]", '{"cut": ']
    second = [{"a": "x", "A": 1.5}]
    got = changes(raw(spark, {("f", 1): first, ("f", 2): second, ("g", 1): second}))
    assert got == {("f/2", "a", None, "retyped")}
    assert changes(raw(spark, {("f", 1): first}).limit(0)) == set()


def test_unified_records_keep_every_branch(spark):
    files = {
        ("f", 1): [{"user_id": "u1", "parent_asin": ["p1"], "text": {"body": "hello", "format": 2}, "timestamp": 1700000000000, "rating": "4", "verifiedPurchase": "TRUE"}],
        ("f", 2): [{"user": {"id": "u2"}, "asin": {"depth": 1, "parent": "p2"}, "reviewText": ["a", "b"], "timestamp": "17", "helpful_vote": None, "helpful_votes": 3}],
        ("f", 3): [{"user": 7}],
    }
    rows = {r.file_seq: r for r in drift.unified_records(raw(spark, files)).collect()}
    assert (rows[1].user_id, rows[1].product_id, rows[1].review_text, rows[1].timestamp, rows[1].rating, rows[1].verified_purchase) == ("u1", "p1", "hello", 1700000000, 4.0, True)
    assert (rows[2].user_id, rows[2].product_id, rows[2].review_text, rows[2].timestamp, rows[2].helpful_votes) == ("u2", "p2", "a b", 17, 3)
    assert (rows[3].user_id, rows[3].user_id_type, rows[3].product_id, rows[3].rating, rows[3].product_id_type) == ("7", "number", None, 0.0, None)


def test_unified_records_have_typed_branches(spark):
    lines = [
        {"user_id": 12345678901234567890, "parent_asin": {"depth": 1, "parent": "p"}, "text": {"body": "b", "format": 2}, "rating": 4.5, "verified_purchase": 1},
        {"user_id": "u", "parent_asin": ["p", None], "text": None, "rating": "4.5", "verified_purchase": 0},
        {"verified_purchase": True},
    ]
    a, b, c = sorted(drift.unified_records(raw(spark, {("f", 1): lines})).collect(), key=lambda r: r.line_no)
    assert (a.verified_purchase, a.verified_purchase_number, b.verified_purchase_number, c.verified_purchase_boolean) == (False, 1.0, 0.0, True)
    assert json.loads(a.review_text_json) == lines[0]["text"] and json.loads(a.product_id_json) == lines[0]["parent_asin"]
    assert json.loads(b.product_id_json) == ["p", None] and (b.product_id_string, b.review_text_json) == (None, None)
    assert (a.user_id_json, a.rating_number, a.rating_string, a.rating_json, b.rating_string, b.rating_number) == ("12345678901234567890", 4.5, None, None, "4.5", None)


def test_nested_type_changes(spark):
    one = [{"a": {"x": 1, "l": [{"k\\\"": 1}, "s"]}, "text": {"body": "some words of a text", "n": 1}, "gone": {"z": 1}}]
    two = [{"a": {"x": "1", "l": [{"k\\\"": None}, "s"], "y": None}, "reviewText": {"body": "some words of a text", "n": "1"}, "new": [1, 2]}]
    df = raw(spark, {("f", 1): one, ("f", 2): two})
    got = {(r.file_seq, r.field_name, r.path, r.json_type): r.n_values for r in drift.tagged_paths(drift.parsed_lines(df)).collect() if r.field_name in ("a", "new")}
    k = r'["l"][*]["k\\\""]'
    assert got == {
        (1, "a", "", "object"): 1, (1, "a", '["x"]', "number"): 1, (1, "a", '["l"]', "array"): 1, (1, "a", '["l"][*]', "object"): 1, (1, "a", '["l"][*]', "string"): 1, (1, "a", k, "number"): 1,
        (2, "a", "", "object"): 1, (2, "a", '["x"]', "string"): 1, (2, "a", '["l"]', "array"): 1, (2, "a", '["l"][*]', "object"): 1, (2, "a", '["l"][*]', "string"): 1, (2, "a", k, "null"): 1, (2, "a", '["y"]', "null"): 1,
        (2, "new", "", "array"): 1, (2, "new", "[*]", "number"): 2,
    }
    nested = {(r.field_name, r.path, r.old_name, r.change_kind) for r in drift.nested_changes(df, drift.schema_changes(df)).collect()}
    assert nested == {("a", '["x"]', None, "retyped"), ("a", k, None, "retyped"), ("a", '["y"]', None, "added"), ("reviewText", '["n"]', "text", "retyped")}
    assert drift.tagged_paths(drift.parsed_lines(df.limit(0))).count() == 0


def test_unified_records_follow_the_contract(spark):
    """Votes fall back on 0, flags are joined by OR, whole numbers in text only, whatever doesn't convert is kept in its branch."""
    lines = [
        {"helpful_vote": 0, "helpful_votes": 7, "verified_purchase": False, "verifiedPurchase": True, "timestamp": "1.5", "rating": "five"},
        {"helpful_vote": "x", "helpful_votes": None, "verified_purchase": 1, "verifiedPurchase": "t", "timestamp": 2.9, "rating": True},
        {"helpful_vote": 3_000_000_000, "verified_purchase": "TRUE", "timestamp": "+5", "rating": "4.5"},
        {"helpful_vote": True, "timestamp": 100000000001},
    ]
    rows = sorted(drift.unified_records(raw(spark, {("f", 1): lines})).collect(), key=lambda r: r.line_no)
    assert [(r.helpful_votes, r.verified_purchase, r.timestamp, r.rating) for r in rows] == [(7, True, 0, 0.0), (0, False, 2, 0.0), (0, True, 5, 4.5), (0, False, 100000000, 0.0)]
    assert (rows[0].rating_string, rows[0].timestamp_string, rows[0].helpful_votes_name, rows[0].verified_purchase_name) == ("five", "1.5", "helpful_votes", "verifiedPurchase")
    assert (rows[1].helpful_votes_string, rows[1].rating_boolean, rows[2].helpful_votes_number) == ("x", True, 3e9)


def test_malformed_lines_are_counted(spark):
    df = raw(spark, {("f", 1): [{"a": 1}, "[1]", None, "", '{"cut": '], ("f", 2): [{}]})
    assert sorted(tuple(r)[1:] for r in drift.line_counts(df).collect()) == [(1, "f/1", 5, 1, 4), (2, "f/2", 1, 1, 0)]


def roles(df):
    return {(r.feed_name, r.field_name): (r.role, r.evidence) for r in drift.role_names(drift.inferred(df)).collect()}


def test_role_names_follow_renames_of_their_feed(spark):
    text = lambda i: f"the {i} lamp fell from its shelf and broke in many pieces"
    chain = ["text", "a1", "a2", "a3", "a4", "a5", "a6", "wording"]
    files = {("f", s): [{name: text(i + 99 * s)} for i in range(20)] for s, name in enumerate(chain, 1)}
    # in feed g the same name carries a product, in h nothing says what it is, in k it is the text once more
    files |= {("g", s): [{name: f"B0{i + 7 * s:03d}XY"} for i in range(20)] for s, name in ((1, "asin"), (2, "wording"))}
    files |= {("h", 1): [{"a3": text(i), "wording": 1} for i in range(20)]}
    got = roles(raw(spark, files))
    assert {k[1]: v for k, v in got.items() if k[0] == "f"} == {n: ("review_text", "own") for n in chain[1:]}
    assert got["g", "wording"] == ("product_id", "own")
    assert got["h", "a3"] == ("review_text", "others") and ("h", "wording") not in got
    df = raw(spark, files)
    rows = drift.unified_records(df, drift.role_names(drift.inferred(df)))
    assert rows.filter("review_text is not null").groupBy("feed_name").count().collect() != []
    assert {(r.feed_name, r.review_text_name or r.product_id_name) for r in rows.filter("feed_name != 'f'").collect()} == {("g", "asin"), ("g", "wording"), ("h", "a3")}


def test_fields_left_over_are_matched_again(spark):
    """Two renames of like content in one step: the second pair is found after the first is taken."""
    text = lambda i, n: " ".join(f"word{(i * 7 + k) % 50}" for k in range(n))
    one = [{"p": text(i, 10), "q": text(i, 13)} for i in range(30)]
    two = [{"r": text(i + 5, 10), "s": text(i + 5, 12)} for i in range(30)]
    assert changes(raw(spark, {("f", 1): one, ("f", 2): two})) == {("f/2", "r", "p", "renamed"), ("f/2", "s", "q", "renamed")}


def _orphans_by_hand(children, parents):
    out = {}
    for table, key, at in children:
        if not key:
            continue
        own = [p for p in parents if p[0] == key]
        past = [p for p in own if p[1] is not None and at is not None and p[1] <= at]
        if not own:
            kind = "missing"
        elif not past:
            kind = "late"
        else:
            newest = max(p[1] for p in past)
            kind = "removed" if any(p[2] for p in past if p[1] == newest) else None
        if kind:
            k = (table, at.strftime("%Y-%m") if at else None, key, kind)
            out[k] = out.get(k, 0) + 1
    return out


def test_orphans_equal_brute_force(spark):
    rnd = random.Random(3)
    t = lambda: dt.datetime(2021, 1, 30, 22) + dt.timedelta(hours=rnd.randrange(90), seconds=rnd.randrange(3))
    keys = ["a", "b", "c", "", None, " a", "A"]
    children = [(rnd.choice(["x", "y"]), rnd.choice(keys), t() if rnd.random() > 0.05 else None) for _ in range(400)]
    parents = [(rnd.choice(["a", "b", "c", "", None, "d"]), t() if rnd.random() > 0.1 else None, rnd.choice([True, False, None])) for _ in range(60)]
    parents += parents[:5]
    c = spark.createDataFrame(children, "t string, k string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "k string, at timestamp_ntz, gone boolean").withColumn("KEY", F.lit(1)).withColumn("cell", F.lit(2))
    refs = [orphans.references(c.filter(F.col("t") == n), n, "k", "at") for n in ("x", "y")]
    got = {tuple(r)[:4]: r.n_refs for r in orphans.orphan_references(refs, p, "k", "at", "gone").collect()}
    assert got == _orphans_by_hand(children, parents)
    assert {r.orphan_kind for r in orphans.orphan_references(refs, p.limit(0), "k", "at", "gone").collect()} == {"missing"}
    assert orphans.orphan_references([r.limit(0) for r in refs], p, "k", "at", "gone").count() == 0


def test_a_hot_day_is_cut_down_to_instants(spark):
    """One key, one day, many parent records: references between them, some within one second and one instant."""
    rnd = random.Random(7)
    day = dt.datetime(2022, 5, 3, 11)
    t = lambda: day + dt.timedelta(minutes=rnd.randrange(3), seconds=rnd.randrange(2), microseconds=rnd.randrange(4))
    children = [("x", "hot", t()) for _ in range(300)] + [("y", "hot", None), ("y", "no", None), ("y", "untimed", day)]
    parents = [("hot", t(), rnd.random() < 0.5) for _ in range(12)] + [("untimed", None, False)]
    c, p = spark.createDataFrame(children, "t string, k string, at timestamp_ntz"), spark.createDataFrame(parents, "k string, at timestamp_ntz, gone boolean")
    refs = [orphans.references(c.filter(F.col("t") == n), n, "k", "at") for n in ("x", "y")]
    want = _orphans_by_hand(children, parents)
    assert want["y", None, "hot", "late"] == 1 and want["y", None, "no", "missing"] == 1 and want["y", "2022-05", "untimed", "late"] == 1
    for widths in (orphans.CELLS, (86_400_000_000, 1), (1,)):
        assert {tuple(r)[:4]: r.n_refs for r in orphans.orphan_references(refs, p, "k", "at", "gone", widths).collect()} == want


def test_close_deletes_every_workspace(spark):
    from pathlib import Path

    from tessera import storage

    storage.Workspace(spark, "x").save(spark.range(3), "t")
    assert list(Path(storage.application_dir(spark)).glob("x-*"))
    storage.close(spark)
    assert not Path(storage.application_dir(spark)).exists()


def test_skewed_groups(spark):
    rows = [("hot", f"u{i % 7}", 86400 * 3 + i, 2.0, 1) for i in range(41)] + [("hot", None, 86400 * 5000, None, None)] * 2
    rows += [("cold", "u", (86400 * 9000 + 5) * 1000, 1.0, 1), ("", "u", 5, 1.0, 1), (None, "u", 5, 1.0, 1), ("cold", "u", 0, 1.0, 1), ("cold", "u", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "product_id string, user_id string, timestamp bigint, rating double, helpful_votes int").withColumn("Bucket", F.lit("x")).withColumn("seconds", F.lit("y"))
    assert [tuple(r) for r in skew.large_groups(df).collect()] == [("hot", 3)]
    got = {(r.product_id, r.bucket): (r.group_rows, r.n_user_id, r.rating_sum) for r in skew.group_results(df).collect()}
    assert got == {("hot", 3): (41, 7, 82.0), ("hot", 5000): (2, 0, None), ("cold", 9000): (1, 1, 1.0)}
    assert skew.group_results(df.limit(0)).count() == 0
