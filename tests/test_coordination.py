import json
import os
from collections import Counter
from dataclasses import replace
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage
from tessera.config import PipelineConfig
from tessera.operators import graph, groups, pairs, score
from tessera.plans import queries
from tessera.plans.pipeline import run
from tessera.sources.console import report
from tessera.sources.parquet import ENRICHED_SCHEMA, read_enriched
from tessera.storage import Workspace

REVIEW = "user_id string, product_id string, timestamp bigint"


def test_group_of_100_stays_and_101_splits_once(spark):
    stay = [(f"u{i}", "a", i * 800) for i in range(100)]
    split = [(f"u{i}", "b", 100) for i in range(101)]
    df = groups.candidate_groups(spark.createDataFrame(stay + split + [("late", "b", 80000)], REVIEW))
    got = {(r.product_id, r.bucket): r.n for r in df.groupBy("product_id", "bucket").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 100, ("b", 0): 101, ("b", 3): 1}


def test_repeats_count_in_size_but_pair_once(spark):
    rows = [("x", "p", 5)] * 60 + [("y", "p", 6)] * 60
    df = groups.candidate_groups(spark.createDataFrame(rows, REVIEW))
    assert [tuple(r) for r in pairs.user_pairs(df).collect()] == [("x", "y", "p", 0)]


def test_edges_need_three_groups(spark):
    rows = [(u, "p", d * 86400 + 1) for d in range(3) for u in ("a", "b")] + [(u, "q", d * 86400 + 1) for d in range(2) for u in ("c", "d")]
    assert [tuple(r) for r in pairs.edges(groups.candidate_groups(spark.createDataFrame(rows, REVIEW))).collect()] == [("a", "b", 3)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12)), max_size=40), st.sampled_from([1, 2, 512]))
def test_blocked_pairs_equal_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, "g int, i int").distinct()
    got = sorted((r.g, r.item_a, r.item_b) for r in pairs.blocked_pairs(df, ["g"], "i", block).collect())
    want = sorted((g, a, b) for g in range(4) for a, b in combinations(sorted({i for h, i in rows if h == g}), 2))
    assert got == want


def labels(df):
    return {r.user_id: r.component_id for r in df.collect()}


@pytest.fixture(scope="module")
def path46(spark):
    names = [f"v{i:02d}" for i in range(46)]
    return spark.createDataFrame([(a, b, 3) for a, b in zip(names, names[1:])], "user_a string, user_b string, weight bigint")


def test_label_modes_on_a_path(path46):
    bounded, converged, coded = (labels(graph.component_labels(path46, m)) for m in ("bounded", "converged", "as_coded"))
    assert len(set(bounded.values())) == 26 and bounded["v45"] == "v25"
    assert set(converged.values()) == {"v00"} and len(converged) == 46
    assert len(set(coded.values())) == 46
    assert labels(graph.bounded_labels(path46, 45)) == converged
    near = labels(graph.bounded_labels(path46, 3))
    assert all(b <= near[v] for v, b in bounded.items())


def test_two_components_and_none(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "c", 4), ("x", "y", 3)], "user_a string, user_b string, weight bigint")
    for mode in ("bounded", "converged"):
        assert labels(graph.component_labels(e, mode)) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
        assert labels(graph.component_labels(e.limit(0), mode)) == {}
    assert graph.unlabelled(graph.initial_labels(e), graph.initial_labels(e)).count() == 0
    with pytest.raises(ValueError):
        graph.component_labels(e, "other")


@pytest.mark.parametrize("mode,expected", [("bounded", 0.475), ("converged", 0.475), ("as_coded", 0.4575)])
def test_smallest_component_score(spark, mode, expected):
    e = spark.createDataFrame([("a", "b", 3)], "user_a string, user_b string, weight bigint")
    row = score.coordination_scores(e, graph.component_labels(e, mode)).first()
    assert row.coordination_score == pytest.approx(expected) and row.edge_count == 1


def test_ranking_ties_by_id(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "component_id string, coordination_score double")
    assert [r.component_id for r in score.rank_components(df, 2).collect()] == ["c", "a"]


def test_pipeline_end_to_end(spark, tmp_path):
    lines = [{"user_id": u, "parent_asin": "p", "timestamp": (d * 86400 + 5) * 1000 + 10**12, "text": "Good!"} for d in range(3) for u in ("a", "b")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "m.jsonl").write_text(json.dumps({"parent_asin": "p", "main_category": "c", "title": "t", "average_rating": "4.5"}))
    config = replace(PipelineConfig(), reviews_path=str(tmp_path / "r.jsonl"), metadata_path=str(tmp_path / "m.jsonl"), output_path=str(tmp_path / "out"))
    results = run(spark, config)
    assert results.columns == ["component_id", "user_count", "edge_count", "total_repeated_groups", "edge_density", "average_repetition", "coordination_score"]
    assert "components: 1" in report(results, 20) and "score=0.4750" in report(results, 20)
    stored = read_enriched(spark, config.output_path)
    assert stored.schema == ENRICHED_SCHEMA and stored.first().review_text == "good" and stored.first().catalog_average_rating == 4.5
    with pytest.raises(AnalysisException):
        run(spark, config)


def test_stream_of_reviews(spark, tmp_path):
    from tessera.streaming.ingest import stream_group_counts, stream_reviews, write_reviews

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"user": "u", "asin": "p", "timestamp": 5, "text": "A b"}\n{"user": null, "asin": "p", "timestamp": 5}')
    schema = T.StructType.fromDDL("user_id string, user string, asin string, timestamp bigint, text string, other int")
    rows = stream_reviews(spark, str(tmp_path / "in"), schema)
    write_reviews(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().review_text == "a b"
    assert stream_group_counts(rows).isStreaming


@pytest.fixture
def wide_joins(spark):
    """No broadcasts, and skew splitting from a few KB on."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    """The adaptive plan after running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_hot_group_are_split(spark, wide_joins, tmp_path):
    hot = F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 40))
    rows = spark.range(0, 40_000, 1, 8).select(F.xxhash64("id").cast("string").alias("user_id"), hot.alias("product_id"), (F.col("id") % 86400 + 86400).alias("timestamp"))
    rows.write.parquet(f"{tmp_path}/rows")
    grouped = groups.candidate_groups(spark.read.parquet(f"{tmp_path}/rows"))
    assert "skew=true" in executed(grouped)
    assert grouped.count() == 40_000


def test_links_of_a_hub_are_split(spark, wide_joins, tmp_path):
    spark.range(1, 40_000, 1, 8).select(F.lit("a").alias("user_a"), F.concat(F.lit("b"), F.xxhash64("id")).alias("user_b")).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    labels = graph.component_labels(edges, "as_coded")
    labels.write.parquet(f"{tmp_path}/labels")
    assert "skew=true" in executed(graph.propagate(graph.symmetric(edges), spark.read.parquet(f"{tmp_path}/labels")))
    assert {r.component_id for r in graph.bounded_labels(edges).select("component_id").distinct().collect()} == {"a"}


def test_pairs_of_a_hot_group_are_made_in_blocks(spark, wide_joins, tmp_path):
    hot = F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 60))
    spark.range(0, 1_500, 1, 4).select(hot.alias("g"), F.format_string("%05d", "id").alias("item")).write.parquet(f"{tmp_path}/m")
    members = spark.read.parquet(f"{tmp_path}/m")
    found = pairs.blocked_pairs(members, ["g"], "item", block_size=50)
    sizes = [r["count"] for r in members.groupBy("g").count().collect()]
    assert found.count() == found.distinct().count() == sum(n * (n - 1) // 2 for n in sizes)
    assert found.filter("item_a >= item_b").count() == 0
    # 24 blocks of the hot group make 300 keys of a pair of blocks; a task joins one of them at a time
    rows = {r.g: r.n for r in found.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert rows["hot"] == 1200 * 1199 // 2


def brute(rows, least=3):
    """Edges of (user, product, bucket) rows."""
    members = {}
    for u, p, b in rows:
        if None not in (u, p, b):
            members.setdefault((p, b), set()).add(u)
    weights = Counter(pair for users in members.values() for pair in combinations(sorted(users), 2))
    return sorted((a, b, w) for (a, b), w in weights.items() if w >= least)


#: Sets of twins of 1 to 9 users, whose ids interleave, along a chain; two lone sets, one of which has too few groups; null keys.
CHAIN = [(f"u{(i * 7 + k * 11) % 100:02d}-{i}", "p", 2 * i + d) for i in range(24) for k in range(1 + i * 5 % 9) for d in range(5)]
CHAIN += [(u, "q", d) for u in ("x", "y", "z") for d in range(4)] + [(u, "r", d) for u in ("few1", "few2") for d in range(2)]
CHAIN += [(u, None, d) for u in ("null1", "null2") for d in range(5)] + [(u, "s", None) for u in ("null1", "null2")] + [(None, "q", d) for d in range(4)]


def chain(spark):
    return spark.createDataFrame(CHAIN, "user_id string, product_id string, bucket bigint")


@pytest.mark.parametrize("per_round", [10**9, 40])
def test_edges_of_twins_and_of_rounds_equal_brute_force(spark, per_round, monkeypatch):
    monkeypatch.setattr(pairs, "LIST", 2)
    found = pairs.twin_edges(chain(spark), replace(PipelineConfig(), pairs_per_round=per_round))
    assert sorted(map(tuple, found.edges().collect())) == brute(CHAIN)
    assert not found.alone and found.found.count() < len(brute(CHAIN)) / 10


def test_without_twins_all_edges_are_found(spark):
    rows = [(f"u{i:02d}", "p", i + d) for i in range(12) for d in range(5)]
    found = pairs.twin_edges(spark.createDataFrame(rows, "user_id string, product_id string, bucket bigint"))
    assert found.alone and sorted(map(tuple, found.edges().collect())) == brute(rows)
    assert sorted(map(tuple, pairs.twin_edges(chain(spark).limit(0)).edges().collect())) == []


@pytest.mark.parametrize("mode,rounds", [("bounded", 0), ("bounded", 1), ("bounded", 3), ("bounded", 20), ("converged", 20), ("as_coded", 20)])
def test_labels_and_scores_of_twins_equal_those_of_listed_edges(spark, mode, rounds):
    found = pairs.twin_edges(chain(spark))
    edges = Workspace(spark, "listed").save(spark.createDataFrame(brute(CHAIN), "user_a string, user_b string, weight bigint"), "edges")
    want, got = graph.component_labels(edges, mode, rounds), graph.twin_labels(found, mode, rounds)
    assert labels(got) == labels(want)
    assert {r.user_id for r in graph.twin_vertices(found).collect()} == set(labels(want))
    mine = score.twin_scores(found, got, graph.twins_share(mode, rounds))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, score.coordination_scores(edges, want).collect()))


def test_least_neighbours_of_twins_equal_those_of_listed_edges(spark):
    edges = spark.createDataFrame(brute(CHAIN), "user_a string, user_b string, weight bigint")
    assert labels(graph.twin_min_neighbours(pairs.twin_edges(chain(spark)))) == labels(graph.min_neighbour_labels(graph.symmetric(edges), graph.initial_labels(edges)))


def test_lines_of_the_whole_job_are_compressed_and_end_with_their_use(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "_as_lines", lambda raw, name, own=queries._as_lines: made.append(own(raw, name)) or made[-1])
    monkeypatch.setattr(queries.pipeline, "analyse", lambda enriched, config: enriched)
    kept = queries.pipeline.ingest
    seen = []
    monkeypatch.setattr(queries.pipeline, "ingest", lambda s, c: seen.extend(os.listdir(made[0].removeprefix("file:"))) or kept(s, c))
    spark.range(3).selectExpr("id AS l_orderkey", "0L AS l_partkey", "1.0D AS l_quantity", "'R' AS l_returnflag", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'1995-01-02' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1).selectExpr("id AS p_partkey", "'b' AS p_brand", "'n' AS p_name", "'t' AS p_type", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    enriched = queries.whole_job(spark, str(tmp_path))
    assert enriched.count() == 3
    assert any(f.endswith(".json.gz") or f.endswith(".txt.gz") for f in seen) and not os.path.exists(made[0].removeprefix("file:"))


def test_rounds_of_users_equal_brute_force(spark):
    space = Workspace(spark, "spent")
    found = pairs.twin_edges(space.save(chain(spark).select("*", groups.user_round(3)), "rows", ["round"]), rounds=3, spent=space)
    assert sorted(map(tuple, found.edges().collect())) == brute(CHAIN)
    assert not os.path.exists(space.root.removeprefix("file:"))


#: Queries that join orders in rounds and delete the joined rows once the members of groups are written.
IN_ROUNDS = ["vertices", "console_report", "labels_as_coded", "coordination_scores_converged", "labels_left_anti", "top_components", "component_metrics", "min_neighbour_labels", "component_sizes"]


@pytest.mark.parametrize("name", IN_ROUNDS)
def test_rounds_give_the_same_rows_and_leave_no_joined_ones(spark, name, monkeypatch):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    want = sorted(map(tuple, queries.queries()[name](spark, folder).collect()))
    saved = []
    monkeypatch.setattr(storage, "ROUND_ROWS", 2000)
    monkeypatch.setattr(Workspace, "save", lambda self, df, table, *how, own=Workspace.save: saved.append(self.path(table)) or own(self, df, table, *how))
    assert sorted(map(tuple, queries.queries()[name](spark, folder).collect())) == want
    assert sum(p.endswith("/rows") for p in saved) >= 3 and {"members-2", "sets-2"} <= {p.rpartition("/")[2] for p in saved}
    assert not [p for p in saved if p.endswith("/rows") and os.path.exists(p.removeprefix("file:"))]


@pytest.mark.parametrize("block,busy", [(512, 10_000), (3, 10_000), (3, 4)])
def test_rounds_shuffle_arrays_and_equal_brute_force(spark, block, busy, monkeypatch):
    rows = [(f"u{i:02d}", f"p{i % 2}", i + d) for i in range(24) for d in range(9)] + [("busy", f"p{k}", d) for k in range(2) for d in range(30)]
    monkeypatch.setattr(pairs, "BUSY", busy, raising=False)
    saved = []
    monkeypatch.setattr(Workspace, "save", lambda self, df, table, *how, own=Workspace.save: saved.append((table, df.count(), self.path(table))) or own(self, df, table, *how))
    found = pairs.twin_edges(spark.createDataFrame(rows, "user_id string, product_id string, bucket bigint"), replace(PipelineConfig(), pairs_per_round=300, pair_block_size=block))
    assert sorted(map(tuple, found.edges().collect())) == brute(rows)
    done = dict(x[:2] for x in saved)
    assert done["gathered"] > 0 and bool(done["large"]) == (block == 3) and done["busy"] == (25 if busy == 4 else 0) and sum(n for t, n, _ in saved if t.startswith("round-")) > 0
    assert not [at for name, _, at in saved if name in ("kept", "gathered", "round-1") and os.path.exists(at.removeprefix("file:"))]
