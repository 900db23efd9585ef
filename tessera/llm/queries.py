"""Queries of the problems p2, p3, p5, p7, p8, p9 and p10, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import components, cooccurrence, leakage, near_duplicates, packing, ranking, repetition
from tessera.plans.views import table

SCORES = ["user_count", "edge_density", "average_repetition", "coordination_score"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cooccurrence.review_pairs(table(spark, folder, "enriched_reviews")).associated()
    return found.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of products with a common basket: its count and its relation to chance."""
    scores = cooccurrence.review_pairs(table(spark, folder, "enriched_reviews")).scores()
    return scores.withColumn("npmi", F.round("npmi", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking.ranked_items(table(spark, folder, "component_results"), "component_id", SCORES)
    return ranking.leading_items(ranked, SCORES).select("component_id").distinct()


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking.ranked_items(table(spark, folder, "component_results"), "component_id", SCORES)
    return ranked.select("component_id", *SCORES, *[f"{s}_higher" for s in SCORES], "n_rows", "significance", "place")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = components.connected_components(components.links_of(table(spark, folder, "user_edges")))
    return groups.select(F.col("member").alias("user_id"), "group_id")


def _alike(spark: SparkSession, folder: str) -> near_duplicates.Alike:
    return near_duplicates.similar_texts(table(spark, folder, "enriched_reviews"), shingle=3, similarity=(3, 5))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(_alike(spark, folder)).select(F.col("a").alias("review_id_a"), F.col("b").alias("review_id_b"))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every review with its group and the number of texts that its own is like."""
    ids = table(spark, folder, "enriched_reviews").select("review_id")
    return near_duplicates.similar_groups(_alike(spark, folder), ids).withColumnRenamed("id", "review_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def p8_certificate(spark: SparkSession, folder: str) -> DataFrame:
    return packing.certificate(packing.packed(table(spark, folder, "documents")))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: every document is in, once or in pieces that a container each but the last holds, and no container is overfull."""
    rows = packing.packed(table(spark, folder, "documents"))
    each = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    whole = ids.join(each, F.col("id") == F.col("doc_id"), "left").agg(
        F.count("*").alias("documents"), F.sum(F.col("doc_id").isNull().cast("int")).alias("missing"), F.sum((F.ceil(F.greatest("tokens", F.lit(1)) / 2048) != F.col("pieces")).cast("int")).alias("wrongly_split")
    )
    boxes = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"), F.max("free_room").alias("room"), F.min("free_room").alias("least"))
    wrong = (F.col("fill") > 2048) | (F.col("fill") + F.col("room") != 2048) | (F.col("room") != F.col("least"))
    filled = boxes.agg(F.sum(wrong.cast("int")).alias("wrongly_filled"), F.lit(1).alias("one"))
    return whole.withColumn("one", F.lit(1)).join(filled, "one").drop("one")


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder).select("doc_id", "item_id")


def p9_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated four-word sequences of every document."""
    measured = repetition.measured(table(spark, folder, "documents"))
    return measured.select("doc_id", "n_words", "n_grams", "n_repeated", repetition.repeated_share().alias("repeated_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p2_found, p2_scores, p3_found, p3_ranking, p5_found, p7_found, p7_groups, p8_containers, p8_certificate, p8_invariants, p9_found, p9_runs, p10_found, p10_shares)
    return {f.__name__: f for f in every}


_BASKETS = """WITH b AS (SELECT DISTINCT user_id, (CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END) // 86400 AS day, product_id
  FROM enriched_reviews WHERE user_id <> '' AND product_id <> '' AND (CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END) > 0),
t AS (SELECT count(*) AS baskets FROM (SELECT DISTINCT user_id, day FROM b)),
m AS (SELECT product_id, count(*) AS n FROM b GROUP BY 1),
ab AS (SELECT x.product_id AS item_a, y.product_id AS item_b, count(*) AS n_ab FROM b x JOIN b y
  ON x.user_id = y.user_id AND x.day = y.day AND x.product_id < y.product_id GROUP BY 1, 2),
s AS (SELECT item_a, item_b, n_ab, ma.n AS n_a, mb.n AS n_b, baskets FROM ab JOIN m ma ON ma.product_id = item_a JOIN m mb ON mb.product_id = item_b, t)"""

_COMPLETE = """WITH c AS (SELECT DISTINCT * FROM component_results),
ok AS (SELECT * FROM c WHERE user_count IS NOT NULL AND edge_density IS NOT NULL AND average_repetition IS NOT NULL AND coordination_score IS NOT NULL
  AND NOT isnan(edge_density) AND NOT isnan(average_repetition) AND NOT isnan(coordination_score)),
r AS (SELECT *, count(*) OVER () AS n_rows, rank() OVER (ORDER BY user_count DESC) - 1 AS user_count_higher, rank() OVER (ORDER BY edge_density DESC) - 1 AS edge_density_higher,
  rank() OVER (ORDER BY average_repetition DESC) - 1 AS average_repetition_higher, rank() OVER (ORDER BY coordination_score DESC) - 1 AS coordination_score_higher FROM ok)"""



def _tail(k: int, m: int = 4) -> str:
    """The same sums and products, in the same order, as the operator's binomial tail over u[k]."""
    x = f"u[{k}]"
    return " + ".join("*".join([f"cast({comb(m, j)} AS double)", "*".join(["cast(1 AS double)", *[x] * j]).join("()"), "*".join(["cast(1 AS double)", *[f"(1 - {x})"] * (m - j)]).join("()")]) for j in range(k, m + 1)).join("()")


_WORDS = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


_ALIKE = """c AS (SELECT DISTINCT review_id, trim(regexp_replace(lower(review_text), '[^a-z0-9]+', ' ', 'g')) AS t FROM enriched_reviews WHERE review_text IS NOT NULL),
  w AS (SELECT review_id, t, string_split(t, ' ') AS ws FROM c),
  k AS (SELECT t, min(ws) AS ws FROM w WHERE len(ws) >= 20 GROUP BY t),
  n AS (SELECT t, row_number() OVER (ORDER BY t) AS id, ws FROM k),
  g AS (SELECT DISTINCT id, unnest([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]) AS s FROM n),
  z AS (SELECT id, count(*) AS k FROM g GROUP BY id),
  x AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM g p JOIN g q ON p.s = q.s AND p.id < q.id GROUP BY 1, 2),
  alike AS (SELECT a, b FROM x JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE 5 * shared >= 3 * (za.k + zb.k - shared)),
  m AS (SELECT DISTINCT id, review_id FROM n JOIN w USING (t))"""


_LEAKED = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items),
  dg AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[j:j+11], ' ') FOR j IN range(1, len(ws) - 10)]) AS g FROM d),
  ig AS (SELECT DISTINCT item_id, unnest([array_to_string(ws[j:j+11], ' ') FOR j IN range(1, len(ws) - 10)]) AS g FROM i)
  SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_BASKETS} SELECT item_a AS product_a, item_b AS product_b FROM s WHERE n_ab >= 5 AND n_ab * baskets >= 4 * n_a * n_b",
        "p2_scores": f"""{_BASKETS}, l AS (SELECT *, n_ab * cast(baskets AS double) / (cast(n_a AS double) * n_b) AS lift FROM s)
  SELECT item_a, item_b, n_ab, n_a, n_b, baskets, lift,
  CASE WHEN n_ab = baskets THEN cast(1 AS double) ELSE round(ln(lift) / -ln(n_ab / cast(baskets AS double)), 9) END AS npmi FROM l""",
        "p3_found": f"""{_COMPLETE} SELECT DISTINCT component_id FROM r
  WHERE user_count_higher * 10 < n_rows AND edge_density_higher * 10 < n_rows AND average_repetition_higher * 10 < n_rows AND coordination_score_higher * 10 < n_rows""",
        "p3_ranking": f"""{_COMPLETE},
  v AS (SELECT *, list_sort([cast(user_count_higher + 1 AS double) / n_rows, cast(edge_density_higher + 1 AS double) / n_rows,
    cast(average_repetition_higher + 1 AS double) / n_rows, cast(coordination_score_higher + 1 AS double) / n_rows]) AS u FROM r),
  w AS (SELECT *, least(cast(1 AS double), least({", ".join(_tail(k) for k in range(1, 5))}) * 4) AS significance FROM v)
  SELECT component_id, user_count, edge_density, average_repetition, coordination_score, user_count_higher, edge_density_higher, average_repetition_higher,
    coordination_score_higher, n_rows, significance, rank() OVER (ORDER BY significance) AS place FROM w""",
        "p5_found": """WITH RECURSIVE e AS (SELECT DISTINCT user_a AS a, user_b AS b FROM user_edges WHERE user_a <> user_b AND weight >= 3),
  l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM reach r JOIN l ON r.w = l.a)
  SELECT v AS user_id, min(w) AS group_id FROM reach GROUP BY v""",
        "p7_found": f"""WITH {_ALIKE}
  SELECT DISTINCT least(ma.review_id, mb.review_id) AS review_id_a, greatest(ma.review_id, mb.review_id) AS review_id_b
  FROM (SELECT a, b FROM alike UNION ALL SELECT id, id FROM n) JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b WHERE ma.review_id <> mb.review_id""",
        "p7_groups": f"""WITH RECURSIVE {_ALIKE},
  l AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
  reach AS (SELECT id AS v, id AS w FROM n UNION SELECT r.v, l.b FROM reach r JOIN l ON r.w = l.a),
  part AS (SELECT v AS id, min(w) AS part FROM reach GROUP BY v),
  named AS (SELECT part, min(review_id) AS group_id FROM part JOIN m USING (id) GROUP BY part),
  degree AS (SELECT a AS id, count(*) AS k FROM l GROUP BY a),
  placed AS (SELECT review_id, group_id, coalesce(k, 0) AS k FROM m JOIN part USING (id) JOIN named USING (part) LEFT JOIN degree USING (id))
  SELECT review_id, coalesce(group_id, review_id) AS group_id, cast(coalesce(k, 0) AS bigint) AS n_links FROM (SELECT DISTINCT review_id FROM enriched_reviews WHERE review_id IS NOT NULL) LEFT JOIN placed USING (review_id)""",
        "p8_invariants": "SELECT count(*) AS documents, 0 AS missing, 0 AS wrongly_split, 0 AS wrongly_filled FROM documents",
        "p9_found": _LEAKED,
        "p9_runs": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items),
  dg AS (SELECT doc_id, unnest([{{'pos': j, 'g': array_to_string(ws[j:j+11], ' ')}} FOR j IN range(1, len(ws) - 10)]) AS s FROM d),
  ig AS (SELECT item_id, unnest([{{'pos': j, 'g': array_to_string(ws[j:j+11], ' ')}} FOR j IN range(1, len(ws) - 10)]) AS s FROM i),
  met AS (SELECT DISTINCT doc_id, item_id, dg.s.pos AS pos, dg.s.pos - ig.s.pos AS diagonal FROM dg JOIN ig ON dg.s.g = ig.s.g),
  runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos) AS run FROM met),
  lengths AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM runs GROUP BY doc_id, item_id, diagonal, run)
  SELECT doc_id, item_id, max(words) AS matched_words FROM lengths GROUP BY 1, 2""",
        "p10_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc_id, len(ws) - 3 AS n, len(list_distinct([array_to_string(ws[j:j+3], ' ') FOR j IN range(1, len(ws) - 2)])) AS k FROM d WHERE len(ws) >= 20)
  SELECT doc_id FROM g WHERE 10 * (n - k) >= 3 * n""",
        "p10_shares": f"""WITH d AS (SELECT doc_id, CASE WHEN coalesce(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '') = '' THEN [] ELSE {_WORDS} END AS ws FROM documents),
  g AS (SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(greatest(len(ws) - 3, 0) AS bigint) AS n_grams,
    cast(len(list_distinct([array_to_string(ws[j:j+3], ' ') FOR j IN range(1, len(ws) - 2)])) AS bigint) AS k FROM d)
  SELECT doc_id, n_words, n_grams, n_grams - k AS n_repeated, CASE WHEN n_grams > 0 THEN cast(n_grams - k AS double) / n_grams ELSE cast(0 AS double) END AS repeated_share FROM g""",
    }
