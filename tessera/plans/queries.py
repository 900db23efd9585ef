"""Queries of the pipeline's own operators over the test tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import PipelineConfig
from tessera.functions import coerce as C
from tessera.functions.text import clean_text
from tessera.functions.timebuckets import time_bucket, to_seconds
from tessera.operators import graph, groups, pairs, reviews, score
from tessera.plans import pipeline
from tessera.plans import views as V
from tessera.sources.console import report
from tessera.sources.jsonl import metadata_records, read_metadata, read_reviews, review_records
from tessera.sources.parquet import read_enriched, write_enriched
from tessera.storage import Workspace, round_count

Query = Callable[[SparkSession, str], DataFrame]
SMALL_LIMIT = PipelineConfig(oversized_group_limit=60)


def _brand_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.edges(groups.candidate_groups(V.orders_brand(spark, folder)))


def _brand_twins(spark: SparkSession, folder: str) -> pairs.TwinEdges:
    """Joins, members and sets go in rounds, and the joined rows are deleted once their members are written."""
    n = round_count(V.table(spark, folder, "lineitem").count())
    space = Workspace(spark, "oversized")
    found = groups.candidate_groups([V.orders_brand(spark, folder, (i, n)) for i in range(n)], space=space, rounds=n)
    return pairs.twin_edges(found, rounds=n, spent=space)


def _documents_clean(spark: SparkSession, folder: str) -> DataFrame:
    return V.table(spark, folder, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


def _raw_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as raw records with alternative names and mixed types."""
    c = V.table(spark, folder, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("row_id"),
        F.when(k % 3 != 0, k.cast("string")).alias("user_id"),
        F.concat(F.lit("u"), k.cast("string")).alias("user"),
        F.when(k % 4 == 0, F.col("c_mktsegment")).alias("asin"),
        F.col("c_nationkey").alias("product_id"),
        F.when(k % 5 == 0, F.lit("1.5x")).when(k % 5 == 1, F.lit("nan?")).otherwise(F.col("c_acctbal").cast("string")).alias("rating"),
        F.when(k % 6 == 0, F.lit(" 12 ")).when(k % 6 == 1, F.lit("1.5")).when(k % 6 == 2, F.lit("+5")).otherwise((k * 1_000_000_000).cast("string")).alias("timestamp"),
        F.when(k % 4 == 1, F.lit("TRUE")).when(k % 4 == 2, F.lit("t")).when(k % 4 == 3, F.lit("1")).alias("verified_purchase"),
        (k % 7 == 0).alias("verifiedPurchase"),
        F.when(k % 2 == 0, F.lit(0)).otherwise(k.cast("int")).alias("helpful_vote"),
        F.when(k % 8 != 0, k.cast("string")).alias("helpful_votes"),
        F.col("c_name").alias("reviewText"),
    )


def coerce_fields(spark: SparkSession, folder: str) -> DataFrame:
    return review_records(_raw_fields(spark, folder))


def coerce_scalars(spark: SparkSession, folder: str) -> DataFrame:
    raw = _raw_fields(spark, folder)
    return raw.select(
        "row_id",
        C.get_string(raw, "product_id").alias("as_string"),
        C.get_string(raw, "absent").alias("absent_string"),
        C.get_double(raw, "rating", -1.0).alias("as_double"),
        C.get_long(raw, "timestamp", -1).alias("as_long"),
        C.get_int(raw, "helpful_votes", -1).alias("as_int"),
        C.get_boolean(raw, "verified_purchase").alias("as_boolean"),
        F.lit(C.has_field(raw, "User_ID")).alias("has_other_case"),
    )


def _as_lines(raw: DataFrame, name: str) -> str:
    """Write records as compressed JSON Lines, null fields left out, and return the folder."""
    space = Workspace(raw.sparkSession, "lines")
    raw.select(F.to_json(F.struct("*"))).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(space.path(name))
    space.release()
    return space.path(name)


def jsonl_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return read_reviews(spark, _as_lines(_raw_fields(spark, folder), "reviews"))


def jsonl_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.valid_metadata(read_metadata(spark, _as_lines(_raw_metadata(spark, folder), "metadata")))


def parquet_sink(spark: SparkSession, folder: str) -> DataFrame:
    at = Workspace(spark, "sink").path("enriched")
    write_enriched(enriched_reviews(spark, folder), at)
    return read_enriched(spark, at)


def whole_job(spark: SparkSession, folder: str) -> DataFrame:
    """JSON Lines files of reviews and metadata to scored components, through every stage."""
    m = V.brand_metadata(spark, folder).select(
        F.col("product_id").alias("parent_asin"), F.col("category").alias("main_category"), F.col("product_title").alias("title"), F.col("catalog_average_rating").alias("average_rating")
    )
    space = Workspace(spark, "job")
    lines = _as_lines(V.orders_reviews(spark, folder, space), "reviews")
    space.drop("ordered")
    config = PipelineConfig(lines, _as_lines(m, "metadata"), space.path("enriched"))
    enriched = pipeline.ingest(spark, config)
    Workspace(spark, "lines", lines.rpartition("/")[0]).drop("reviews")
    return pipeline.analyse(enriched, config)


def _raw_metadata(spark: SparkSession, folder: str) -> DataFrame:
    p = V.table(spark, folder, "part")
    return p.select(
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("parent_asin"),
        F.when(F.col("p_partkey") % 3 == 1, F.col("p_partkey")).alias("asin"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("main_category"),
        F.col("p_name").alias("category"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").cast("string").alias("average_rating"),
    )


def metadata_fields(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.valid_metadata(metadata_records(_raw_metadata(spark, folder)))


def normalize_ms(spark: SparkSession, folder: str) -> DataFrame:
    e = V.table(spark, folder, "events").select("event_id", V.epoch(F.col("ts")).alias("s"))
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("s") * 1000 + F.col("event_id") % 1000).otherwise(F.col("s"))
    return e.select("event_id", to_seconds(mixed).alias("seconds"))


def valid_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.valid_reviews(V.table(spark, folder, "enriched_reviews")).select("review_id", "user_id", "product_id", "timestamp")


def cleaned_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.cleaned_reviews(V.table(spark, folder, "enriched_reviews")).select("review_id", "review_text")


def _bucket(hours: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        e = V.table(spark, folder, "events").select("event_id", V.epoch(F.col("ts")).alias("s"))
        return e.select("event_id", time_bucket(F.col("s"), hours).alias("bucket"))

    return query


def enriched_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.enrich(reviews.cleaned_reviews(V.orders_reviews(spark, folder)), V.brand_metadata(spark, folder))


def enriched_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews and catalogue records of the test tables; repeated records multiply the reviews."""
    r = V.table(spark, folder, "enriched_reviews").select(
        "user_id", "product_id", "rating", to_seconds(F.col("timestamp")).alias("timestamp"), "review_text", "verified_purchase", "helpful_votes"
    )
    m = V.table(spark, folder, "product_meta").select(
        F.col("parent_asin").alias("product_id"), F.col("main_category").alias("category"), F.col("title").alias("product_title"), F.coalesce("average_rating", F.lit(0.0)).alias("catalog_average_rating")
    )
    joined = reviews.enrich(reviews.cleaned_reviews(reviews.valid_reviews(r)), reviews.valid_metadata(m))
    return joined.groupBy("product_id", "product_title", "category", "catalog_average_rating").agg(
        F.count("*").alias("joined_rows"), F.min("timestamp").alias("first_seen"), F.sum(F.length("review_text")).alias("text_chars")
    )


def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_sizes(V.orders_brand(spark, folder), 24)


def candidate_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = groups.candidate_groups(V.events_type(spark, folder), SMALL_LIMIT)
    return g.groupBy("product_id", "bucket").agg(F.count("*").alias("group_rows"), F.countDistinct("user_id").alias("users"))


def candidate_groups_100(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the orders, split above the default of 100 rows."""
    g = groups.candidate_groups(V.orders_brand(spark, folder))
    return g.groupBy("product_id", "bucket").agg(F.count("*").alias("group_rows"), F.countDistinct("user_id").alias("users"))


def user_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.user_pairs(groups.candidate_groups(V.events_key(spark, folder), SMALL_LIMIT), SMALL_LIMIT)


def brand_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _brand_edges(spark, folder)


def event_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.edges(groups.candidate_groups(V.events_type(spark, folder), SMALL_LIMIT), SMALL_LIMIT)


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.twin_vertices(_brand_twins(spark, folder))


def symmetric_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.symmetric(_brand_edges(spark, folder))


def min_neighbour_labels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.twin_min_neighbours(_brand_twins(spark, folder))


def _labels(mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return graph.twin_labels(_brand_twins(spark, folder), mode)

    return query


def labels_left_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Users with no proposal: here those that are never the second end of an edge."""
    e = _brand_twins(spark, folder)
    initial = graph.twin_labels(e, "as_coded")
    proposed = graph.twin_min_neighbours(e).filter(F.col("component_id") < F.col("user_id"))
    return graph.unlabelled(initial, proposed)


def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return score.component_sizes(graph.twin_labels(_brand_twins(spark, folder)))


def component_metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = _brand_twins(spark, folder)
    return score.twin_metrics(e, graph.twin_labels(e), True)


def _scores(mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        e = _brand_twins(spark, folder)
        return score.twin_scores(e, graph.twin_labels(e, mode), graph.twins_share(mode, PipelineConfig().component_iterations))

    return query


def top_components(spark: SparkSession, folder: str) -> DataFrame:
    return score.rank_components(_scores("bounded")(spark, folder), PipelineConfig().top_k)


def console_report(spark: SparkSession, folder: str) -> DataFrame:
    """The printed report, one row per line."""
    lines = report(_scores("bounded")(spark, folder), PipelineConfig().top_k).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def component_count(spark: SparkSession, folder: str) -> DataFrame:
    return _scores("bounded")(spark, folder).agg(F.count("*").alias("components"))


def queries() -> dict[str, Query]:
    return {
        "clean_text": _documents_clean,
        "coerce_fields": coerce_fields,
        "coerce_scalars": coerce_scalars,
        "metadata_fields": metadata_fields,
        "jsonl_reviews": jsonl_reviews,
        "jsonl_metadata": jsonl_metadata,
        "parquet_sink": parquet_sink,
        "whole_job": whole_job,
        "normalize_ms": normalize_ms,
        "valid_reviews": valid_reviews,
        "cleaned_reviews": cleaned_reviews,
        "time_bucket_24h": _bucket(24),
        "time_bucket_6h": _bucket(6),
        "enriched_reviews": enriched_reviews,
        "enriched_fanout": enriched_fanout,
        "group_sizes": group_sizes,
        "candidate_groups": candidate_groups,
        "candidate_groups_100": candidate_groups_100,
        "user_pairs": user_pairs,
        "edges": brand_edges,
        "event_edges": event_edges,
        "vertices": vertices,
        "symmetric_edges": symmetric_edges,
        "min_neighbour_labels": min_neighbour_labels,
        "labels_bounded20": _labels("bounded"),
        "labels_converged": _labels("converged"),
        "labels_as_coded": _labels("as_coded"),
        "labels_left_anti": labels_left_anti,
        "component_sizes": component_sizes,
        "component_metrics": component_metrics,
        "coordination_scores": _scores("bounded"),
        "coordination_scores_converged": _scores("converged"),
        "coordination_scores_as_coded": _scores("as_coded"),
        "top_components": top_components,
        "component_count": component_count,
        "console_report": console_report,
    }


_BRAND = """orders_brand AS (
  SELECT cast(o_custkey AS varchar) AS user_id, p_brand AS product_id, cast(floor(epoch(o_orderdate)) AS bigint) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_EVENT_TYPE = "SELECT cast(user_id AS varchar) AS user_id, event_type AS product_id, cast(floor(epoch(ts)) AS bigint) AS ts FROM events"
_EVENT_KEY = "SELECT cast(user_id AS varchar) AS user_id, json_extract_string(props, '$.k') AS product_id, cast(floor(epoch(ts)) AS bigint) AS ts FROM events"


def _groups_sql(source: str, limit: int) -> str:
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY product_id, ts // 86400) AS n FROM {source}),
grouped AS (SELECT user_id, product_id, CASE WHEN n > {limit} THEN ts // 21600 ELSE ts // 86400 END AS bucket FROM sized),
members AS (SELECT DISTINCT product_id, bucket, user_id FROM grouped),
pairs AS (SELECT a.user_id AS user_a, b.user_id AS user_b, a.product_id, a.bucket FROM members a JOIN members b
  ON a.product_id = b.product_id AND a.bucket = b.bucket AND a.user_id < b.user_id),
edges AS (SELECT user_a, user_b, count(*) AS weight FROM pairs GROUP BY user_a, user_b HAVING count(*) >= 3)"""


_EDGES = f"{_BRAND},\n{_groups_sql('orders_brand', 100)}"
_LINKS = """links AS (SELECT user_a AS src, user_b AS dst FROM edges UNION ALL SELECT user_b, user_a FROM edges),
verts AS (SELECT DISTINCT src AS v FROM links),
loops AS (SELECT src, dst FROM links UNION ALL SELECT v, v FROM verts)"""


def _labels_sql(mode: str) -> str:
    if mode == "as_coded":
        return f"{_EDGES},\n{_LINKS},\nlabels AS (SELECT v AS user_id, v AS component_id FROM verts)"
    rounds = {"bounded": 20, "converged": 60}[mode]
    return f"""{_EDGES},
{_LINKS},
walk AS (SELECT v, v AS lab, 0 AS it FROM verts
  UNION ALL SELECT s.dst, min(w.lab), w.it + 1 FROM walk w JOIN loops s ON s.src = w.v WHERE w.it < {rounds} GROUP BY s.dst, w.it),
labels AS (SELECT v AS user_id, lab AS component_id FROM walk WHERE it = {rounds})"""


def _scores_sql(mode: str) -> str:
    return f"""{_labels_sql(mode)},
sizes AS (SELECT component_id, count(*) AS user_count FROM labels GROUP BY component_id),
metrics AS (SELECT component_id, count(*) AS edge_count, cast(sum(weight) AS bigint) AS total_repeated_groups
  FROM edges JOIN labels ON user_a = user_id GROUP BY component_id),
parts AS (SELECT *, cast(edge_count AS double) / CASE WHEN user_count <= 1 THEN cast(1 AS double)
    ELSE cast(user_count AS double) * (cast(user_count AS double) - 1) / cast(2 AS double) END AS edge_density,
  CASE WHEN edge_count = 0 THEN cast(0 AS double) ELSE cast(total_repeated_groups AS double) / cast(edge_count AS double) END AS average_repetition
  FROM metrics JOIN sizes USING (component_id)),
scores AS (SELECT component_id, user_count, edge_count, total_repeated_groups, edge_density, average_repetition,
  (cast(0.35 AS double) * least(cast(user_count AS double) / cast(20 AS double), cast(1 AS double)) + cast(0.35 AS double) * edge_density)
  + cast(0.30 AS double) * least(average_repetition / cast(10 AS double), cast(1 AS double)) AS coordination_score FROM parts)"""


_CLEAN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"

_RAW = """raw AS (SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 3 <> 0 THEN cast(c_custkey AS varchar) END AS user_id,
  'u' || cast(c_custkey AS varchar) AS user_2,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS asin,
  cast(c_nationkey AS varchar) AS product_id,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_acctbal END AS rating,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 5 ELSE c_custkey * 1000000000 END AS ts,
  c_custkey % 4 = 1 AS verified_1, c_custkey % 7 = 0 AS verified_2,
  CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE cast(c_custkey AS integer) END AS vote_1,
  CASE WHEN c_custkey % 8 <> 0 THEN cast(c_custkey AS integer) END AS vote_2,
  c_name FROM customer)"""


def oracle_sql() -> dict[str, str]:
    own = _oracle_sql()
    same = {"jsonl_reviews": "coerce_fields", "jsonl_metadata": "metadata_fields", "parquet_sink": "enriched_reviews", "whole_job": "coordination_scores"}
    return own | {name: own[other] for name, other in same.items()}


def _oracle_sql() -> dict[str, str]:
    with_edges = f"WITH {_EDGES}"
    return {
        "clean_text": f"SELECT doc_id, {_CLEAN.format('text')} AS clean FROM documents",
        "coerce_fields": f"""WITH {_RAW} SELECT coalesce(user_id, user_2) AS user_id, coalesce(asin, product_id) AS product_id,
  coalesce(rating, cast(0 AS double)) AS rating, CASE WHEN coalesce(ts, 0) > 100000000000 THEN coalesce(ts, 0) // 1000 ELSE coalesce(ts, 0) END AS timestamp,
  c_name AS review_text, verified_1 OR verified_2 AS verified_purchase,
  cast(CASE WHEN vote_1 <> 0 THEN vote_1 ELSE coalesce(vote_2, 0) END AS integer) AS helpful_votes FROM raw""",
        "coerce_scalars": f"""WITH {_RAW} SELECT row_id, product_id AS as_string, cast(NULL AS varchar) AS absent_string, coalesce(rating, cast(-1 AS double)) AS as_double,
  coalesce(ts, -1) AS as_long, coalesce(vote_2, -1) AS as_int, verified_1 AS as_boolean, false AS has_other_case FROM raw""",
        "metadata_fields": """SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE cast(p_partkey AS varchar) END AS product_id,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS category, p_name AS product_title, p_retailprice AS catalog_average_rating
  FROM part WHERE p_partkey % 3 < 2""",
        "normalize_ms": """WITH e AS (SELECT event_id, cast(floor(epoch(ts)) AS bigint) AS s FROM events),
  m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN s * 1000 + event_id % 1000 ELSE s END AS t FROM e)
  SELECT event_id, CASE WHEN t > 100000000000 THEN t // 1000 ELSE t END AS seconds FROM m""",
        "valid_reviews": "SELECT review_id, user_id, product_id, timestamp FROM enriched_reviews WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND timestamp > 0",
        "cleaned_reviews": f"SELECT review_id, {_CLEAN.format('review_text')} AS review_text FROM enriched_reviews",
        "time_bucket_24h": "SELECT event_id, cast(floor(epoch(ts)) AS bigint) // 86400 AS bucket FROM events",
        "time_bucket_6h": "SELECT event_id, cast(floor(epoch(ts)) AS bigint) // 21600 AS bucket FROM events",
        "enriched_reviews": f"""WITH r AS (SELECT cast(o_custkey AS varchar) AS user_id, p_brand AS product_id, l_quantity AS rating,
  cast(floor(epoch(o_orderdate)) AS bigint) AS timestamp, {_CLEAN.format("p_name || ' - ' || o_orderpriority")} AS review_text,
  l_returnflag = 'R' AS verified_purchase, l_linenumber AS helpful_votes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  m AS (SELECT p_brand AS product_id, min(p_type) AS category, min(p_name) AS product_title, max(p_retailprice) AS catalog_average_rating FROM part GROUP BY 1)
  SELECT user_id, product_id, rating, timestamp, review_text, verified_purchase, helpful_votes, category, product_title, catalog_average_rating FROM r JOIN m USING (product_id)""",
        "enriched_fanout": f"""WITH r AS (SELECT product_id, CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END AS ts, {_CLEAN.format("review_text")} AS txt, user_id FROM enriched_reviews)
  SELECT product_id, title AS product_title, main_category AS category, coalesce(average_rating, 0.0) AS catalog_average_rating,
  count(*) AS joined_rows, min(ts) AS first_seen, cast(sum(length(txt)) AS bigint) AS text_chars
  FROM r JOIN product_meta ON parent_asin = product_id WHERE user_id IS NOT NULL AND ts > 0 GROUP BY 1, 2, 3, 4""",
        "group_sizes": f"WITH {_BRAND} SELECT product_id, ts // 86400 AS bucket, count(*) AS group_rows FROM orders_brand GROUP BY 1, 2",
        "candidate_groups": f"""WITH src AS ({_EVENT_TYPE}), {_groups_sql('src', 60)}
  SELECT product_id, bucket, count(*) AS group_rows, count(DISTINCT user_id) AS users FROM grouped GROUP BY 1, 2""",
        "candidate_groups_100": f"""WITH {_BRAND}, {_groups_sql('orders_brand', 100)}
  SELECT product_id, bucket, count(*) AS group_rows, count(DISTINCT user_id) AS users FROM grouped GROUP BY 1, 2""",
        "user_pairs": f"WITH src AS ({_EVENT_KEY}), {_groups_sql('src', 60)} SELECT user_a, user_b, product_id, bucket FROM pairs",
        "edges": f"{with_edges} SELECT user_a, user_b, weight FROM edges",
        "event_edges": f"WITH src AS ({_EVENT_TYPE}), {_groups_sql('src', 60)} SELECT user_a, user_b, weight FROM edges",
        "vertices": f"{with_edges} SELECT user_a AS user_id FROM edges UNION SELECT user_b FROM edges",
        "symmetric_edges": f"{with_edges} SELECT user_a AS src, user_b AS dst FROM edges UNION ALL SELECT user_b, user_a FROM edges",
        "min_neighbour_labels": f"{with_edges},\n{_LINKS} SELECT dst AS user_id, min(src) AS component_id FROM links GROUP BY dst",
        "labels_bounded20": f"WITH RECURSIVE {_labels_sql('bounded')} SELECT user_id, component_id FROM labels",
        "labels_converged": f"WITH RECURSIVE {_labels_sql('converged')} SELECT user_id, component_id FROM labels",
        "labels_as_coded": f"WITH {_labels_sql('as_coded')} SELECT user_id, component_id FROM labels",
        "labels_left_anti": f"""{with_edges} SELECT DISTINCT user_a AS user_id, user_a AS component_id FROM edges e
  WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.user_b = e.user_a)""",
        "component_sizes": f"WITH RECURSIVE {_labels_sql('bounded')} SELECT component_id, count(*) AS user_count FROM labels GROUP BY component_id",
        "component_metrics": f"""WITH RECURSIVE {_labels_sql('bounded')} SELECT component_id, count(*) AS edge_count, cast(sum(weight) AS bigint) AS total_repeated_groups
  FROM edges JOIN labels ON user_a = user_id GROUP BY component_id""",
        "coordination_scores": f"WITH RECURSIVE {_scores_sql('bounded')} SELECT * FROM scores",
        "coordination_scores_converged": f"WITH RECURSIVE {_scores_sql('converged')} SELECT * FROM scores",
        "coordination_scores_as_coded": f"WITH {_scores_sql('as_coded')} SELECT * FROM scores",
        "top_components": f"WITH RECURSIVE {_scores_sql('bounded')} SELECT * FROM scores ORDER BY coordination_score DESC, component_id LIMIT 20",
        "console_report": f"""WITH RECURSIVE {_scores_sql('bounded')},
  best AS (SELECT *, row_number() OVER (ORDER BY coordination_score DESC, component_id) AS place FROM scores)
  SELECT cast(0 AS integer) AS line_no, 'components: ' || count(*) AS line FROM scores UNION ALL
  SELECT cast(place AS integer), printf('%3d. %s  users=%d edges=%d repeats=%d density=%.4f repetition=%.4f score=%.4f', place, component_id, user_count, edge_count, total_repeated_groups,
    edge_density, average_repetition, coordination_score) FROM best WHERE place <= 20""",
        "component_count": f"WITH RECURSIVE {_scores_sql('bounded')} SELECT count(*) AS components FROM scores",
    }
