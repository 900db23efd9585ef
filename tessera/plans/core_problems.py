"""Queries of schema drift (p1), orphan references (p4) and skewed keys (p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift, orphans, skew
from tessera.plans.views import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(table(spark, folder, "raw_reviews")).select("file_name", "field_name", "change_kind").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every change with its types, as text, before and after; ``path`` is '' for a field and else the place below it."""
    raw = table(spark, folder, "raw_reviews")
    changes = drift.schema_changes(raw)
    c = changes.withColumn("path", F.lit("")).unionByName(drift.nested_changes(raw, changes))
    return c.select("feed_name", "file_seq", "file_name", "field_name", "path", "old_name", "change_kind", F.array_join("old_types", "|").alias("old_types"), F.array_join("new_types", "|").alias("new_types"))


def p1_tagged_fields(spark: SparkSession, folder: str) -> DataFrame:
    return drift.tagged_fields(drift.parsed_lines(table(spark, folder, "raw_reviews")))


def p1_tagged_paths(spark: SparkSession, folder: str) -> DataFrame:
    return drift.tagged_paths(drift.parsed_lines(table(spark, folder, "raw_reviews")))


def p1_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The names besides the known alternatives that carry a role in a feed."""
    return drift.role_names(drift.inferred(table(spark, folder, "raw_reviews")))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_reviews")
    return drift.unified_records(raw, drift.role_names(drift.inferred(raw)))


def p1_known_names(spark: SparkSession, folder: str) -> DataFrame:
    """The unified table under the known names alone."""
    return drift.unified_records(table(spark, folder, "raw_reviews"))


def p1_lines(spark: SparkSession, folder: str) -> DataFrame:
    return drift.line_counts(table(spark, folder, "raw_reviews"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    reviews = orphans.references(table(spark, folder, "enriched_reviews"), "enriched_reviews", "product_id", "ingested_at")
    documents = orphans.references(table(spark, folder, "documents"), "documents", "product_id", "written_at")
    return orphans.orphan_references([reviews, documents], table(spark, folder, "product_meta"), "parent_asin", "loaded_at", "is_removed")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "ref_month", F.col("key").alias("product_id"), "orphan_kind")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan keys and references per table, month and kind."""
    return _orphans(spark, folder).groupBy("table_name", "ref_month", "orphan_kind").agg(F.count("*").alias("keys"), F.sum("n_refs").alias("refs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.large_groups(table(spark, folder, "enriched_reviews"))


def p6_group_results(spark: SparkSession, folder: str) -> DataFrame:
    return skew.group_results(table(spark, folder, "enriched_reviews"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p1_tagged_fields, p1_tagged_paths, p1_roles, p1_unified, p1_known_names, p1_lines, p4_found, p4_report, p6_found, p6_group_results)}


_ORPHANS = """WITH refs AS (
  SELECT 'enriched_reviews' AS table_name, product_id AS k, ingested_at AS t FROM enriched_reviews WHERE product_id <> ''
  UNION ALL SELECT 'documents', product_id, written_at FROM documents WHERE product_id <> ''),
par AS (SELECT parent_asin AS k, loaded_at, bool_or(coalesce(is_removed, false)) AS gone FROM product_meta WHERE parent_asin IS NOT NULL GROUP BY 1, 2),
seen AS (SELECT refs.*, par.loaded_at, par.gone FROM refs ASOF LEFT JOIN par ON refs.k = par.k AND refs.t >= par.loaded_at),
found AS (SELECT table_name, strftime(t, '%Y-%m') AS ref_month, k AS product_id,
  CASE WHEN k NOT IN (SELECT k FROM par) THEN 'missing' WHEN loaded_at IS NULL THEN 'late' WHEN gone THEN 'removed' END AS orphan_kind FROM seen),
orphan AS (SELECT table_name, ref_month, product_id, orphan_kind, count(*) AS n FROM found WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3, 4)"""

_DAYS = """WITH timed AS (SELECT *, CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END AS seconds FROM enriched_reviews),
days AS (SELECT *, seconds // 86400 AS bucket FROM timed WHERE product_id <> '' AND seconds > 0)"""


#: Names of the test tables' own feeds, as read from the files, that carry a role.
OWN_NAMES = {"user_id": ["account_key", "reviewer"], "product_id": ["item_ref"], "review_text": ["comment_full", "review_body"], "rating": ["stars"], "timestamp": ["posted"]}


def _unified_sql(more: dict[str, list[str]]) -> str:
    names = ", ".join(f"('{r}', {i}, '{n}')" for r, known in drift.ROLE_NAMES.items() for i, n in enumerate(known + more.get(r, [])))
    one = lambda role, value: f"max(CASE WHEN role = '{role}' THEN {value} END)"
    split = [f"{one(r, c)} AS {r}_{n}" for r in drift.ROLE_NAMES for n, c in (("type", "kind"), ("name", "name"), ("string", "as_string"), ("number", "as_number"), ("boolean", "as_boolean"), ("json", "as_json"))]
    return f"""WITH names(role, place, name) AS (VALUES {names}),
ok AS (SELECT row_number() OVER () AS rid, feed_name, file_name, file_seq, line_no, cast(payload AS json) AS j FROM raw_reviews WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
long AS (SELECT rid, role, place, name, json_extract(j, '$."' || name || '"') AS v FROM ok, names),
kinds AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind
  FROM long WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
texts AS (SELECT *, CASE kind
    WHEN 'array' THEN nullif(array_to_string(list_transform(cast(v AS json[]), lambda e: e ->> '$'), ' '), '')
    WHEN 'object' THEN coalesce(
      list_filter(list_transform(list_sort(json_keys(v)), lambda k: CASE WHEN json_type(json_extract(v, '$."' || k || '"')) = 'VARCHAR' THEN json_extract_string(v, '$."' || k || '"') END), lambda t: t IS NOT NULL)[1],
      json_extract_string(v, '$."' || list_sort(json_keys(v))[1] || '"'))
    ELSE v ->> '$' END AS txt FROM kinds),
read AS (SELECT *, CASE WHEN kind = 'number' OR (kind <> 'boolean' AND regexp_full_match(txt, '[+-]?[0-9]+')) THEN trunc(try_cast(txt AS decimal(38, 6))) END AS whole,
  coalesce(lower(txt) = 'true', false) AS flag FROM texts),
chosen AS (SELECT *, CASE WHEN kind = 'string' THEN txt END AS as_string, CASE WHEN kind = 'number' THEN cast(txt AS double) END AS as_number, CASE WHEN kind = 'boolean' THEN flag END AS as_boolean,
  CASE WHEN kind = 'array' THEN cast(v AS varchar)
    WHEN kind = 'object' THEN '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda k: '"' || k || '":' || cast(json_extract(v, '$."' || k || '"') AS varchar)), ',') || '}}'
    WHEN kind = 'number' AND length(ltrim(regexp_replace(txt, '[-.]|[eE].*', '', 'g'), '0')) > 15 THEN txt END AS as_json FROM read
  QUALIFY row_number() OVER (PARTITION BY rid, role ORDER BY (role = 'verified_purchase' AND NOT flag) OR (role = 'helpful_votes' AND coalesce(try_cast(whole AS integer), 0) = 0), place) = 1),
stamped AS (SELECT *, coalesce(try_cast(whole AS bigint), 0) AS big FROM chosen)
SELECT any_value(feed_name) AS feed_name, any_value(file_name) AS file_name, any_value(file_seq) AS file_seq, any_value(line_no) AS line_no,
  {one('user_id', 'txt')} AS user_id, {one('product_id', 'txt')} AS product_id, {one('review_text', 'txt')} AS review_text,
  coalesce({one('rating', "CASE WHEN kind <> 'boolean' THEN try_cast(txt AS double) END")}, cast(0 AS double)) AS rating,
  coalesce({one('timestamp', 'CASE WHEN big > 100000000000 THEN big // 1000 ELSE big END')}, 0) AS timestamp,
  coalesce({one('verified_purchase', 'flag')}, false) AS verified_purchase, coalesce({one('helpful_votes', 'coalesce(try_cast(whole AS integer), 0)')}, 0) AS helpful_votes,
  {", ".join(split)}
FROM ok LEFT JOIN stamped USING (rid) GROUP BY rid"""


def _changes_sql() -> str:
    """Renames by reading: names of one role take over from one another, no other names do."""
    groups = ", ".join(f"('{r}', '{n}')" for r, known in drift.ROLE_NAMES.items() for n in known + OWN_NAMES.get(r, []))
    return f"""roles(role, name) AS (VALUES {groups}),
ok AS (SELECT feed_name, file_seq, cast(payload AS json) AS j FROM raw_reviews WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
keys AS (SELECT *, unnest(json_keys(j)) AS name FROM ok),
kinds AS (SELECT feed_name, file_seq, name, CASE json_type(json_extract(j, '$."' || name || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
  WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM keys),
fields AS (SELECT feed_name, file_seq, name, list_sort(list_distinct(list(kind))) AS types, role FROM kinds LEFT JOIN roles USING (name) GROUP BY ALL),
files AS (SELECT feed_name, file_seq, min(file_name) AS file_name, lag(file_seq) OVER (PARTITION BY feed_name ORDER BY file_seq) AS before FROM raw_reviews GROUP BY 1, 2),
steps AS (SELECT * FROM files WHERE before IS NOT NULL),
new AS (SELECT feed_name, s.file_seq, file_name, name, types, role FROM steps s JOIN fields USING (feed_name, file_seq)),
old AS (SELECT s.feed_name, s.file_seq, file_name, name, types, role FROM steps s JOIN fields f ON f.feed_name = s.feed_name AND f.file_seq = s.before),
fresh AS (SELECT * FROM new ANTI JOIN old USING (feed_name, file_seq, name)),
gone AS (SELECT * FROM old ANTI JOIN new USING (feed_name, file_seq, name)),
renamed AS (SELECT feed_name, file_seq, f.file_name, f.name, g.name AS was, f.types, g.types AS had FROM fresh f JOIN gone g USING (feed_name, file_seq, role)
  QUALIFY row_number() OVER (PARTITION BY feed_name, file_seq, role ORDER BY f.name, g.name) = 1)"""


_PATHS = """top AS (SELECT feed_name, file_seq, file_name, cast(payload AS json) AS j FROM raw_reviews WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
named AS (SELECT *, unnest(json_keys(j)) AS field_name FROM top),
tree AS (SELECT feed_name, file_seq, file_name, field_name, '' AS path, json_extract(j, '$."' || field_name || '"') AS v FROM named
  UNION ALL SELECT feed_name, file_seq, file_name, field_name, path || part.step, part.v FROM (
    SELECT *, unnest(CASE json_type(v)
      WHEN 'OBJECT' THEN [{'step': '["' || replace(replace(k, '\\', '\\\\'), '"', '\\"') || '"]', 'v': json_extract(v, '$."' || k || '"')} FOR k IN json_keys(v)]
      WHEN 'ARRAY' THEN [{'step': '[*]', 'v': e} FOR e IN cast(v AS json[])] ELSE [] END) AS part FROM tree)),
paths AS (SELECT feed_name, file_seq, file_name, field_name, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
  WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS json_type, count(*) AS n_values FROM tree GROUP BY ALL)"""

_REPORT = """changes AS (
  SELECT feed_name, file_seq, file_name, name AS field_name, was AS old_name, 'renamed' AS change_kind, had AS old_t, types AS new_t FROM renamed
  UNION ALL SELECT feed_name, file_seq, file_name, name, was, 'retyped', had, types FROM renamed WHERE types <> had
  UNION ALL SELECT feed_name, file_seq, file_name, name, NULL, 'added', NULL, types FROM fresh ANTI JOIN renamed USING (feed_name, file_seq, name)
  UNION ALL SELECT feed_name, file_seq, file_name, name, NULL, 'removed', types, NULL FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed_name = g.feed_name AND r.file_seq = g.file_seq AND r.was = g.name)
  UNION ALL SELECT feed_name, file_seq, new.file_name, name, NULL, 'retyped', old.types, new.types FROM new JOIN old USING (feed_name, file_seq, name) WHERE new.types <> old.types),
below AS (SELECT feed_name, file_seq, field_name, path, list_sort(list_distinct(list(json_type) FILTER (json_type <> 'null'))) AS types FROM paths WHERE path <> '' GROUP BY ALL),
newer AS (SELECT feed_name, file_seq, field_name, path, coalesce(types, []) AS new_t FROM steps JOIN below USING (feed_name, file_seq)),
older AS (SELECT s.feed_name, s.file_seq, coalesce(r.name, b.field_name) AS field_name, path, r.was AS old_name, coalesce(b.types, []) AS old_t
  FROM steps s JOIN below b ON b.feed_name = s.feed_name AND b.file_seq = s.before LEFT JOIN renamed r ON r.feed_name = s.feed_name AND r.file_seq = s.file_seq AND r.was = b.field_name),
nested AS (SELECT feed_name, file_seq, field_name, path, old_name, CASE WHEN old_t IS NULL THEN 'added' WHEN new_t IS NULL THEN 'removed' WHEN old_t <> new_t THEN 'retyped' END AS change_kind, old_t, new_t
  FROM newer FULL JOIN older USING (feed_name, file_seq, field_name, path)
  ANTI JOIN (SELECT feed_name, file_seq, field_name FROM changes WHERE change_kind IN ('added', 'removed')) USING (feed_name, file_seq, field_name))
SELECT feed_name, file_seq, file_name, field_name, '' AS path, old_name, change_kind, array_to_string(old_t, '|') AS old_types, array_to_string(new_t, '|') AS new_types FROM changes
UNION ALL SELECT feed_name, file_seq, file_name, field_name, path, old_name, change_kind, array_to_string(old_t, '|'), array_to_string(new_t, '|') FROM nested JOIN steps USING (feed_name, file_seq) WHERE change_kind IS NOT NULL"""

_FOUND = """SELECT file_name, name AS field_name, 'renamed' AS change_kind FROM renamed
UNION ALL SELECT file_name, name, 'retyped' FROM renamed WHERE types <> had
UNION ALL SELECT file_name, name, 'added' FROM fresh ANTI JOIN renamed USING (feed_name, file_seq, name)
UNION ALL SELECT file_name, name, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed_name = g.feed_name AND r.file_seq = g.file_seq AND r.was = g.name)
UNION ALL SELECT new.file_name, name, 'retyped' FROM new JOIN old USING (feed_name, file_seq, name) WHERE new.types <> old.types"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_tagged_fields": """WITH ok AS (SELECT feed_name, file_seq, file_name, cast(payload AS json) AS j FROM raw_reviews WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  names AS (SELECT *, unnest(json_keys(j)) AS field_name FROM ok),
  typed AS (SELECT *, json_type(json_extract(j, '$."' || field_name || '"')) AS t FROM names)
  SELECT feed_name, file_seq, file_name, field_name, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
    WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS json_type, count(*) AS n_values FROM typed GROUP BY 1, 2, 3, 4, 5""",
        "p1_found": f"WITH {_changes_sql()} {_FOUND}",
        "p1_tagged_paths": f"WITH RECURSIVE {_PATHS} SELECT * FROM paths",
        "p1_report": f"WITH RECURSIVE {_changes_sql()}, {_PATHS}, {_REPORT}",
        "p1_roles": f"""WITH {_changes_sql()},
  own AS (SELECT feed_name, name FROM renamed UNION SELECT feed_name, was FROM renamed)
  SELECT DISTINCT feed_name, name AS field_name, role, CASE WHEN (feed_name, name) IN (SELECT (feed_name, name) FROM own) THEN 'own' ELSE 'others' END AS evidence
  FROM fields WHERE role IS NOT NULL AND name NOT IN ({", ".join(f"'{n}'" for known in drift.ROLE_NAMES.values() for n in known)})""",
        "p1_unified": _unified_sql(OWN_NAMES),
        "p1_known_names": _unified_sql({}),
        "p1_lines": """SELECT feed_name, file_seq, file_name, count(*) AS lines, count(*) FILTER (good) AS well_formed, count(*) FILTER (NOT good) AS malformed
  FROM (SELECT *, coalesce(CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END, false) AS good FROM raw_reviews) GROUP BY 1, 2, 3""",
        "p4_found": f"{_ORPHANS} SELECT table_name, ref_month, product_id, orphan_kind FROM orphan",
        "p4_report": f"{_ORPHANS} SELECT table_name, ref_month, orphan_kind, count(*) AS keys, cast(sum(n) AS bigint) AS refs FROM orphan GROUP BY 1, 2, 3",
        "p6_found": f"{_DAYS} SELECT product_id, bucket FROM days GROUP BY 1, 2 HAVING count(*) > 40",
        "p6_group_results": f"""{_DAYS} SELECT product_id, bucket, count(*) AS group_rows, min(seconds) AS first_seen, max(seconds) AS last_seen,
  cast(sum(cast(rating AS decimal(28, 10))) AS double) AS rating_sum, cast(sum(helpful_votes) AS bigint) AS votes, count(DISTINCT user_id) AS n_user_id FROM days GROUP BY 1, 2""",
    }
