import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, cooccurrence, ranking

MEMBER = "owner string, day bigint, item string"


def brute(baskets):
    n, pair = Counter(), Counter()
    for items in baskets.values():
        n.update(items)
        pair.update(combinations(sorted(items), 2))
    total = sum(1 for x in baskets.values() if x)
    return {p: k for p, k in pair.items() if k >= 2 and k * total >= 2 * n[p[0]] * n[p[1]]}, n, total


def test_incremental_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    table = cooccurrence.PairTable(spark, buckets=3, min_support=2, lift=2, block_size=2)
    baskets = {}
    rows = lambda: [(f"o{rnd.randrange(9)}", rnd.randrange(2), f"i{rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])}") for _ in range(25)]
    for step in range(3):
        add, drop = rows() + [(None, 1, "i1"), ("o1", None, "i1")], rows()[: 8 * step]
        table.apply(spark.createDataFrame(add, MEMBER).select("*", F.lit(1).alias("Item2")), spark.createDataFrame(drop, MEMBER) if drop else None)
        for o, d, i in add:
            if o and d is not None:
                baskets.setdefault((o, d), set()).add(i)
        for o, d, i in drop:
            baskets.get((o, d), set()).discard(i)
        want, n, total = brute(baskets)
        got = {(r.item_a, r.item_b): r.n_ab for r in table.associated().collect()}
        assert got == want and table.baskets == total
        assert {r["item"]: r.n for r in table.read("marginals").collect()} == {k: v for k, v in n.items() if v}
    again = cooccurrence.PairTable(spark, table.space.root, buckets=3, min_support=2, lift=2)
    assert again.baskets == total and again.associated().count() == len(want)
    s = again.scores().first()
    assert s.lift == pytest.approx(s.n_ab * total / (s.n_a * s.n_b))
    assert cooccurrence.changed_scores(table).count() <= table.scores().count()
    with pytest.raises(ValueError):
        cooccurrence.PairTable(spark, table.space.root, buckets=4, min_support=2, lift=2)


def test_scores_hold_every_pair(spark):
    # "hot" is in every basket, "rare" in one; neither can be associated
    baskets = {("o", d): {"hot", *(["x", "y"] if d < 3 else ["z"]), *(["rare"] if d == 0 else [])} for d in range(12)}
    rows = [(o, d, i) for (o, d), items in baskets.items() for i in items]
    table = cooccurrence.PairTable(spark, buckets=3, min_support=3, lift=4, block_size=2)
    table.apply(spark.createDataFrame(rows[:14], MEMBER))
    table.apply(spark.createDataFrame(rows[10:] + [("o", 1, "gone")], MEMBER))
    table.apply(None, spark.createDataFrame([("o", 1, "gone")], MEMBER))
    n, pair = Counter(), Counter()
    for items in baskets.values():
        n.update(items)
        pair.update(combinations(sorted(items), 2))
    want = {(a, b): (k, n[a], n[b], 12, pytest.approx(k * 12 / (n[a] * n[b]))) for (a, b), k in pair.items()}
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.baskets, r.lift) for r in table.scores().collect()} == want
    assert ("hot", "rare") in want and [(r.item_a, r.item_b) for r in table.associated().collect()] == [("x", "y")]
    other = cooccurrence.PairTable(spark, table.space.root, buckets=3, min_support=1, lift=1)
    assert other.associated().count() == sum(k * 12 >= n[a] * n[b] for (a, b), k in pair.items())


def test_a_small_batch_reads_and_writes_its_buckets_only(spark):
    rows = [(f"o{k % 50}", 0, f"i{k * 7 % 90}") for k in range(400)]
    table = cooccurrence.PairTable(spark, buckets=40, min_support=1, lift=1)
    table.apply(spark.createDataFrame(rows, MEMBER))
    was = {t: dict(f) for t, f in table.files.items()}
    seen, real = {}, table.read

    def read(name, only=None):
        seen[name] = only
        return real(name, only)

    table.read = read
    table.apply(spark.createDataFrame([("o1", 0, "new")], MEMBER))
    in_basket = len({i for o, _, i in rows if o == "o1"})
    for name, most in (("members", 1), ("marginals", 1), ("pairs", in_basket)):
        changed = {b for b in was[name] | table.files[name] if was[name].get(b) != table.files[name].get(b)}
        assert seen[name] is not None and changed <= seen[name] and len(seen[name]) <= most


def test_a_batch_that_fails_leaves_the_former_state(spark):
    from pathlib import Path

    table = cooccurrence.PairTable(spark, buckets=3, min_support=1, lift=1)
    table.apply(spark.createDataFrame([("o", 0, "a"), ("o", 0, "b")], MEMBER))
    real = table._commit
    table._commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.apply(spark.createDataFrame([("o", 0, "c")], MEMBER))
    again = cooccurrence.PairTable(spark, table.space.root, min_support=1, lift=1)
    assert again.buckets == 3 and [(r.item_a, r.item_b) for r in again.scores().collect()] == [("a", "b")]
    # a manifest cut off while it was written is no version
    Path(again.space.path("manifest-2")).mkdir()
    again = cooccurrence.PairTable(spark, table.space.root, min_support=1, lift=1)
    assert again.version == 1
    for i in range(4):
        again.apply(spark.createDataFrame([("o", 0, f"c{i}")], MEMBER))
    assert again.scores().count() == 15 and again.version == 5
    kept = {p.name for p in Path(again.space.root).glob("manifest-*")}
    assert kept == {"manifest-4", "manifest-5"}
    named = {p for f in (again.files, again.before) for t in f.values() for p in t.values()}
    assert {str(p) for p in Path(again.space.root).glob("pairs-v*/bucket=*")} <= named
    assert real is not None


def test_baskets_of_reviews(spark):
    rows = [("u", "a", 5), ("u", "a", 5), ("u", "b", 86399), ("u", "b", (86399 + 10**9) * 1000), ("", "a", 5), (None, "a", 5), ("u", "", 5), ("u", None, 5), ("u", "c", 0), ("u", "c", None), ("u", "c", -1)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, timestamp bigint").select("*", F.lit(1).alias("USER_ID"), F.lit(2).alias("owner"))
    assert sorted(map(tuple, cooccurrence.user_day_baskets(df).collect())) == [("u", 0, "a"), ("u", 0, "b"), ("u", 11575, "b")]
    empty = cooccurrence.PairTable(spark, buckets=2)
    empty.apply(cooccurrence.user_day_baskets(df).limit(0))
    assert empty.associated().count() == 0 and empty.baskets == 0


SCORES = ["x", "y", "z"]


def test_ranks_equal_brute_force(spark):
    rnd = random.Random(2)
    value = lambda: rnd.choice([None, math.nan, 1e9, -1.0, 0.0, -0.0, *[rnd.randrange(5) * 1.0 for _ in range(30)]])
    rows = [(f"c{i}", value(), value(), value()) for i in range(120)]
    rows += rows[:10] + [(None, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double").select("*", F.lit(1).alias("score"), F.lit(0).alias("X"), F.lit(0).alias("place"))
    full = [r for r in {repr(r): r for r in rows}.values() if all(v is not None and not math.isnan(v) for v in r[1:])]
    n = len(full)
    got = {r.id: r for r in ranking.ranked_items(df, "id", SCORES, values_per_slice=3).collect()}
    assert len(got) == n
    rho = {}
    for r in full:
        higher = [sum(o[k] > r[k] for o in full) for k in (1, 2, 3)]
        assert [got[r[0]][f"{s}_higher"] for s in SCORES] == higher and got[r[0]].n_rows == n
        u = sorted((h + 1) / n for h in higher)
        p = [sum(math.comb(3, j) * x**j * (1 - x) ** (3 - j) for j in range(k, 4)) for k, x in enumerate(u, 1)]
        rho[r[0]] = min(1.0, 3 * min(p))
        assert got[r[0]].significance == pytest.approx(rho[r[0]])
    order = sorted(got.values(), key=lambda r: r.place)
    assert all(a.significance <= b.significance for a, b in zip(order, order[1:])) and order[0].place == 1
    led = {r.id for r in ranking.leading_items(ranking.ranked_items(df, "id", SCORES), SCORES, 2).collect()}
    assert led == {r[0] for r in full if all(2 * sum(o[k] > r[k] for o in full) < n for k in (1, 2, 3))}
    assert ranking.ranked_items(df.limit(0), "id", SCORES).count() == 0


def test_rank_ignores_scale(spark):
    rows = [(f"c{i}", float(i), float((i * 7) % 30), float((i * 11) % 30)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double")
    scaled = df.withColumn("x", F.exp("x"))
    place = lambda d: {r.id: r.place for r in ranking.ranked_items(d, "id", SCORES).collect()}
    assert place(df) == place(scaled)


def test_head_of_the_ranking_has_no_ties(spark):
    df = spark.range(60_000).select(F.col("id").cast("string").alias("id"), *[(F.col("id") * k).cast("double").alias(s) for k, s in enumerate(SCORES, 1)])
    head = ranking.ranked_items(df, "id", SCORES, values_per_slice=9_000).orderBy("place").limit(50).collect()
    assert [(r.place, r.id) for r in head] == [(k + 1, str(59_999 - k)) for k in range(50)]
    assert head[0].significance == pytest.approx(3 * (1 / 60_000) ** 3, rel=1e-9, abs=0)
    with pytest.raises(ValueError):
        ranking.ranked_items(df, "id", [])


def test_large_integers_do_not_tie(spark):
    df = spark.createDataFrame([("a", 2**53, 1), ("b", 2**53 + 1, 1), ("c", -(2**53) - 1, 2)], "id string, x bigint, y int")
    got = {r.id: (r.x_higher, r.y_higher) for r in ranking.ranked_items(df, "id", ["x", "y"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 1), "c": (2, 0)}


def test_leaders_come_through_the_significance(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)).cast("double").alias(s) for k, s in enumerate(SCORES)])
    ranked = ranking.ranked_items(df, "id", SCORES)
    by_ranks = ranked.filter(" and ".join(f"{s}_higher * 2 < n_rows" for s in SCORES))
    assert by_ranks.count() > 20
    assert {r.id for r in ranking.leading_items(ranked, SCORES, 2).collect()} == {r.id for r in by_ranks.collect()}
    none = ranking.leading_items(ranked.withColumn("significance", F.lit(1.0)), SCORES, 2)
    assert none.count() == 0


def test_components_equal_union_find(spark):
    rnd = random.Random(9)
    rows = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}", rnd.choice([1, 2, 3, 4, None])) for _ in range(70)]
    rows += [(f"p{i:03d}", f"p{i + 1:03d}", 3) for i in range(40)] + [("hub", f"s{i}", 5) for i in range(30)] + [(None, "a", 9), ("a", None, 9), ("a", "a", 9), ("", "q", 3)] + rows[:5]
    df = spark.createDataFrame(rows, "user_a string, user_b string, weight bigint").select("*", F.lit(0).alias("u"), F.lit(0).alias("Weight"))
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in rows:
        if a is not None and b is not None and a != b and (w or 0) >= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = [tuple(r) for r in components.connected_components(components.links_of(df)).collect()]
    assert dict(got) == {x: root(x) for x in parent} and len(got) == len(parent)
    assert components.connected_components(components.links_of(df.limit(0))).count() == 0


def test_links_of_a_hub_are_split(spark, tmp_path):
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        hash_of = F.concat(F.lit("m"), F.xxhash64("id"))
        rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 5 < 4, hash_of).otherwise(F.lit("z")).alias("u"), F.when(F.col("id") % 5 < 4, F.lit("hub")).otherwise(hash_of).alias("v"))
        rows.write.parquet(f"{tmp_path}/links")
        links = spark.read.parquet(f"{tmp_path}/links")
        components.least_below(links).write.parquet(f"{tmp_path}/least")
        least = spark.read.parquet(f"{tmp_path}/least")
        for star in (components.large_star, components.small_star):
            df = star(links, least)
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
