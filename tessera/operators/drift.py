"""Schema drift between files of JSON lines: tagged-union inference and a report of every change.

Each line is parsed once, in the JVM, to a variant. Fusing the schemas of all lines gives, per file
and field, the set of JSON types met (a tagged union: conflicting types stay apart as branches) and
a content profile. Consecutive files of a feed are compared through these compact tables only, so
whatever the size of the files, what is shuffled by feed is one row per file and field.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.coerce import INTEGER_TEXT
from tessera.functions.columns import pick
from tessera.functions.timebuckets import to_seconds
from tessera.storage import Workspace

#: Alternative names of each role, in order of precedence.
ROLE_NAMES = {
    "user_id": ["user_id", "user"],
    "product_id": ["parent_asin", "asin", "product_id"],
    "review_text": ["text", "reviewText"],
    "rating": ["rating"],
    "timestamp": ["timestamp"],
    "verified_purchase": ["verified_purchase", "verifiedPurchase"],
    "helpful_votes": ["helpful_vote", "helpful_votes"],
}
#: JSON types in order.
JSON_TYPES = ("array", "boolean", "number", "object", "string")
#: Columns of the input; others are ignored.
LINE_COLUMNS = ["feed_name", "file_name", "file_seq", "line_no", "payload"]
#: Least similarity of the contents of two fields, one gone and one new, that makes a rename.
RENAME_SIMILARITY = 0.6
#: What a difference in the share of lines beyond its sampling error takes off the similarity.
PRESENCE_WEIGHT = 3.0
#: The sampling error in standard errors.
PRESENCE_ERRORS = 1.5
#: Classes of first characters in a field's profile, a power of two.
OPENINGS = 32


def parsed_lines(raw: DataFrame) -> DataFrame:
    """The lines with ``v``: ``payload`` as a variant object, null if the line isn't one well-formed JSON object.

    The line is parsed as the only element of an array, which rejects text after the object. Null and
    empty lines, lines with a repeated name, other JSON values and cut-off lines all give null.
    """
    raw = pick(raw, *LINE_COLUMNS)
    text = F.trim(F.col("payload"))
    parsed = F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    return raw.withColumn("v", F.when(one, F.try_variant_get(parsed, "$[0]", "variant"))).drop("payload")


def json_type(value: Column) -> Column:
    """JSON type of a variant; null for JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def canonical_text(value: Column) -> Column:
    """One text for any branch: scalars as they are, an array's elements joined by blanks, of an object
    its first text member by name (else its first member); null for JSON null and what holds no value."""
    items = F.try_variant_get(value, "$", "array<string>")
    members = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    texts = F.filter(F.transform(members, lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string"))), lambda s: s.isNotNull())
    others = F.transform(members, lambda m: F.try_variant_get(m, "$", "string"))
    kind = json_type(value)
    return (
        F.when(kind == "array", F.nullif(F.array_join(items, " "), F.lit("")))
        .when(kind == "object", F.coalesce(F.get(texts, 0), F.get(others, 0)))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def field_values(parsed: DataFrame) -> DataFrame:
    """Long form: one row per line and top-level field, with its JSON type and canonical text.

    Names are compared exactly; the lateral explode is narrow."""
    rows = parsed.filter(F.col("v").isNotNull()).select("feed_name", "file_seq", "file_name", "v")
    exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return exploded.select(
        "feed_name", "file_seq", "file_name", F.col("key").alias("field_name"), json_type(F.col("value")).alias("json_type"), canonical_text(F.col("value")).alias("text")
    )


def tagged_fields(parsed: DataFrame) -> DataFrame:
    """The tagged union of every file: (feed_name, file_seq, file_name, field_name, json_type, n_values).

    JSON nulls count under the type ``null``."""
    return (
        field_values(parsed)
        .withColumn("json_type", F.coalesce("json_type", F.lit("null")))
        .groupBy("feed_name", "file_seq", "file_name", "field_name", "json_type")
        .agg(F.count("*").alias("n_values"))
    )


def tagged_paths(parsed: DataFrame) -> DataFrame:
    """The tagged union at every depth: the columns of ``tagged_fields`` and ``path``, the place below the field.

    A field itself has the path ''; a member adds ``["name"]``, and all elements of an array share ``[*]``.
    One level of objects and arrays is opened at a time, until a level holds none."""
    space = Workspace(parsed.sparkSession, "paths")
    at = ["feed_name", "file_seq", "file_name", "field_name", "path"]
    explode = lambda df: df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    nests = json_type(F.col("value")).isin("object", "array")
    counts = tagged_fields(parsed).select(*at[:-1], F.lit("").alias("path"), "json_type", "n_values")
    counts.write.parquet(space.path("counts"))
    top = explode(parsed.filter(F.col("v").isNotNull()).select("feed_name", "file_seq", "file_name", "v"))
    level = space.save(top.filter(nests).select(*at[:-2], F.col("key").alias("field_name"), F.lit("").alias("path"), F.col("value").alias("v")), "level-0")
    n = 0
    while not level.isEmpty():
        name = F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        step = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit('["'), name, F.lit('"]')))
        below = explode(level).select(*at[:-1], F.concat("path", step).alias("path"), "value")
        typed = below.withColumn("json_type", F.coalesce(json_type(F.col("value")), F.lit("null")))
        typed.groupBy(*at, "json_type").agg(F.count("*").alias("n_values")).write.mode("append").parquet(space.path("counts"))
        n += 1
        level = space.save(below.filter(nests).select(*at, F.col("value").alias("v")), f"level-{n}")
        space.drop(f"level-{n - 1}")
    return parsed.sparkSession.read.schema(counts.schema).parquet(space.path("counts"))


def _profiles(parsed: DataFrame) -> DataFrame:
    """Per file and field: its set of types and the measures that describe its contents.

    Values are first summed up by what they begin with, in hash tables of plain numbers; these few rows then
    make the profile. Different values are counted by one bit of 64 per first-character class, which tells apart
    some hundreds."""
    key = ["feed_name", "file_seq", "file_name", "field_name"]
    text = F.col("text")
    kind = F.create_map(*[x for i, t in enumerate(JSON_TYPES) for x in (F.lit(t), F.lit(1 << i))])
    values = field_values(parsed).select(
        *key,
        text,
        F.element_at(kind, F.col("json_type")).alias("kind"),
        # only what begins like a number is parsed: text that isn't one costs an exception
        F.when(F.ascii(F.trim(text)).between(ord("+"), ord("9")), text.try_cast("double")).alias("number"),
        # upper and lower case fall together
        F.ascii(text).bitwiseAND(F.lit(OPENINGS - 1)).alias("opening"),
    )
    total = lambda test: F.sum(test.cast("int"))
    trimmed = F.trim(text)
    by_opening = values.groupBy(*key, "opening").agg(
        F.bit_or("kind").alias("kinds"),
        F.count("*").alias("lines"),
        F.count("text").alias("filled"),
        F.sum(F.length(text)).alias("chars"),
        F.sum(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).alias("words"),
        F.count("number").alias("numeric"),
        total(F.lower(text).isin("true", "false")).alias("truth"),
        total(text != F.lower(text)).alias("upper"),
        total(text != F.upper(text)).alias("lower"),
        total(F.col("number") == 0).alias("zero"),
        F.sum(F.log10(F.abs("number") + 1)).alias("magnitude"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(text), F.lit(64)).cast("int"))).alias("met"),
    )
    free = F.lit(64) - F.bit_count("met")
    many = F.when(F.col("filled") > 0, -64 * F.log(F.greatest(free, F.lit(1)) / 64))
    shares = ("chars", "words", "numeric", "truth", "upper", "lower")
    sums = by_opening.groupBy(*key).agg(
        F.bit_or("kinds").alias("kinds"),
        *[F.sum(c).cast("double").alias(c) for c in ("lines", "filled", *shares, "zero", "magnitude")],
        F.sum(many).alias("distinct"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("opening") == i, F.col("filled"))), F.lit(0)).cast("double") for i in range(OPENINGS)]).alias("openings"),
    )
    types = F.array_compact(F.array(*[F.when(F.col("kinds").bitwiseAND(F.lit(1 << i)) > 0, t) for i, t in enumerate(JSON_TYPES)]))
    part = lambda c, of: F.when(F.col(of) > 0, F.col(c) / F.col(of))
    lines = parsed.filter(F.col("v").isNotNull()).groupBy("feed_name", "file_seq").agg(F.count("*").cast("double").alias("n_lines"))
    return sums.join(lines, ["feed_name", "file_seq"]).select(
        *key,
        types.alias("types"),
        "lines",
        "filled",
        *[part(c, "filled").alias(c) for c in shares],
        part("zero", "numeric").alias("zero"),
        part("magnitude", "numeric").alias("magnitude"),
        "distinct",
        "openings",
        "n_lines",
        (F.col("lines") / F.col("n_lines")).alias("presence"),
    )


def _role(name: Column) -> Column:
    role = F.lit(None).cast("string")
    for key, names in ROLE_NAMES.items():
        role = F.when(name.isin(names), F.lit(key)).otherwise(role)
    return role


def _similarity(g: str, n: str) -> Column:
    """0 to 1: how alike the contents of a gone and a new field are, whatever their JSON types.

    Factors: size (of numbers their order of magnitude and share of zeros, of texts their length, words and
    letters), what the values begin with, the share of numbers and of truth values, the share of lines that
    have the field beyond its sampling error, and the number of different values, absolutely or per line."""
    a, b = (lambda c: F.coalesce(F.col(f"{g}.{c}"), F.lit(0.0))), (lambda c: F.coalesce(F.col(f"{n}.{c}"), F.lit(0.0)))
    near = lambda c: F.lit(1.0) - F.abs(a(c) - b(c))
    quotient = lambda x, y, plus: F.least(x + plus, y + plus) / F.greatest(x + plus, y + plus)
    ratio = lambda c, plus: quotient(a(c), b(c), plus)
    numbers = ratio("magnitude", 0.1) * near("zero")
    texts = ratio("chars", 2.0) * F.sqrt(ratio("words", 0.5)) * (0.6 + 0.2 * near("upper") + 0.2 * near("lower"))
    met = F.aggregate(F.zip_with(f"{g}.openings", f"{n}.openings", lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda x, y: x + y)
    begun = met / F.greatest(F.sqrt(a("filled") * b("filled")), F.lit(1.0))
    values = F.when((a("numeric") > 0.9) & (b("numeric") > 0.9), numbers).otherwise(texts) * (0.5 + 0.5 * begun)
    kinds = near("truth") * (0.5 + 0.5 * near("numeric"))
    both = (a("presence") * a("n_lines") + b("presence") * b("n_lines")) / (a("n_lines") + b("n_lines"))
    error = F.sqrt(both * (1 - both) * (1 / a("n_lines") + 1 / b("n_lines")))
    presence = F.greatest(F.lit(0.0), 1 - PRESENCE_WEIGHT * F.greatest(F.lit(0.0), F.abs(a("presence") - b("presence")) - PRESENCE_ERRORS * error))
    per_value = lambda side: side("distinct") / F.greatest(side("filled"), F.lit(1))
    variety = F.greatest(ratio("distinct", 1.0), quotient(per_value(a), per_value(b), 0.05))
    return F.sqrt(values) * kinds * presence * (0.7 + 0.3 * variety)


def _steps(raw: DataFrame) -> DataFrame:
    """(feed_name, file_seq, file_name, before): every file that has a preceding one in its feed."""
    files = pick(raw, *LINE_COLUMNS).groupBy("feed_name", "file_seq").agg(F.min("file_name").alias("file_name"))
    order = Window.partitionBy("feed_name").orderBy("file_seq")
    return files.withColumn("before", F.lag("file_seq").over(order)).filter("before is not null")


def _blocks(side: str, name: str, spread: bool) -> Column:
    """Keys under which a field can meet a field of the other side that is similar enough.

    A similarity of RENAME_SIMILARITY needs sizes within the factor 1 / RENAME_SIMILARITY^2: orders of
    magnitude if both fields hold numbers, lengths otherwise. Alternatives of one role always meet."""
    width = -2 * math.log(RENAME_SIMILARITY) + 1e-6
    at = lambda c, plus: F.floor(F.log(F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0)) + plus) / width)
    near = lambda kind, b: [F.concat(F.lit(kind), (b + d).cast("string")) for d in ((-1, 0, 1) if spread else (0,))]
    return F.array_compact(F.array(F.concat(F.lit("role "), _role(F.col(name))), *near("size ", at("magnitude", 0.1)), *near("length ", at("chars", 2.0))))


def _candidates(fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Scored pairs of a new and a gone field of one file that may be a rename; a pair meets under one key only."""
    key = ["feed_name", "file_seq"]
    known, was = _role(F.col("field_name")), _role(F.col("old_name"))
    same, other = F.coalesce(known == was, F.lit(False)), F.coalesce(known != was, F.lit(False))
    left = fresh.withColumn("block", F.explode(_blocks("n", "field_name", True)))
    right = gone.withColumn("block", F.explode(_blocks("g", "old_name", False)))
    numbers = (F.coalesce(F.col("g.numeric"), F.lit(0.0)) > 0.9) & (F.coalesce(F.col("n.numeric"), F.lit(0.0)) > 0.9)
    place = F.when(same, "role").when(numbers, "size").otherwise("length")
    met = left.join(right, [*key, "block"]).filter(~other & F.col("block").startswith(place))
    scored = met.withColumn("score", _similarity("g", "n") + same.cast("double")).filter(F.col("score") >= RENAME_SIMILARITY)
    return scored.select(*key, "field_name", "old_name", "score", F.col("g.types").alias("old_types"), F.col("n.types").alias("new_types"))


def _mutual_best(scored: DataFrame, space: Workspace) -> DataFrame:
    """Pairs that are each other's best; then of the fields left over again, until no pair is left."""
    key = ["feed_name", "file_seq"]
    best = lambda mine, other: F.row_number().over(Window.partitionBy(*key, mine).orderBy(F.desc("score"), other))
    chosen, left, i = [], scored, 0
    while not chosen or not left.isEmpty():
        ranked = left.withColumn("x", best("field_name", "old_name")).withColumn("y", best("old_name", "field_name"))
        now = space.save(ranked.filter("x = 1 and y = 1").drop("x", "y"), f"chosen-{i}")
        chosen.append(now)
        rest = left.join(now.select(*key, "field_name"), [*key, "field_name"], "left_anti").join(now.select(*key, "old_name"), [*key, "old_name"], "left_anti")
        left, i = space.save(rest.select(*scored.columns), f"left-{i}"), i + 1
    return reduce(DataFrame.unionByName, chosen)


@dataclass(frozen=True)
class Inference:
    """What one pass over the lines tells: ``changes`` from file to file, and the ``fields`` (feed_name, field_name) that occur; written tables."""

    changes: DataFrame
    fields: DataFrame


def schema_changes(raw: DataFrame) -> DataFrame:
    """(feed_name, file_seq, file_name, field_name, old_name, change_kind, old_types, new_types).

    Each file is compared with the one of the same feed that precedes it in ``file_seq``; files without
    a well-formed line have no fields. A rename is a new and a gone field that are each other's best
    match among those not yet matched: alternatives of one role count as alike, of two different roles
    never do, and all other names go by content alone. Exact ties go to the smaller name.
    """
    return inferred(raw).changes


def inferred(raw: DataFrame) -> Inference:
    """The changes that ``schema_changes`` describes and the fields that occur, from one pass over the lines."""
    space = Workspace(raw.sparkSession, "drift")
    parsed = parsed_lines(raw)
    profiles = space.save(_profiles(parsed), "profiles")
    steps = _steps(raw)
    measures = [c for c in profiles.columns if c not in ("feed_name", "file_seq", "file_name", "field_name")]
    packed = profiles.select("feed_name", "file_seq", "field_name", F.struct(*measures).alias("p"))
    new = steps.join(packed, ["feed_name", "file_seq"]).select("feed_name", "file_seq", "field_name", F.col("p").alias("n"))
    old = steps.join(packed.withColumnRenamed("file_seq", "before"), ["feed_name", "before"]).select("feed_name", "file_seq", "field_name", F.col("p").alias("g"))
    sides = space.save(new.join(old, ["feed_name", "file_seq", "field_name"], "full"), "sides")
    gone = sides.filter("n is null").select("feed_name", "file_seq", F.col("field_name").alias("old_name"), "g")
    fresh = sides.filter("g is null").select("feed_name", "file_seq", "field_name", "n")
    scored = space.save(_candidates(fresh, gone), "scored")
    chosen = _mutual_best(scored, space)
    renamed = chosen.select("feed_name", "file_seq", "field_name", "old_name", "old_types", "new_types")
    key = ["feed_name", "file_seq"]
    added = fresh.join(renamed.select(*key, "field_name"), [*key, "field_name"], "left_anti")
    removed = gone.join(renamed.select(*key, "old_name"), [*key, "old_name"], "left_anti")
    none = F.lit(None).cast("string")
    no_types = F.lit(None).cast("array<string>")
    shape = lambda df, name, old, kind, before, after: df.select(*key, name.alias("field_name"), old.alias("old_name"), F.lit(kind).alias("change_kind"), before.alias("old_types"), after.alias("new_types"))
    c = F.col
    kept = sides.filter("n is not null and g is not null")
    changes = (
        shape(added, c("field_name"), none, "added", no_types, c("n.types"))
        .unionByName(shape(removed, c("old_name"), none, "removed", c("g.types"), no_types))
        .unionByName(shape(renamed, c("field_name"), c("old_name"), "renamed", c("old_types"), c("new_types")))
        .unionByName(shape(renamed.filter("old_types != new_types"), c("field_name"), c("old_name"), "retyped", c("old_types"), c("new_types")))
        .unionByName(shape(kept.filter("n.types != g.types"), c("field_name"), none, "retyped", c("g.types"), c("n.types")))
    )
    named = changes.join(steps.select("feed_name", "file_seq", "file_name"), key)
    return Inference(space.save(named, "changes"), profiles.select("feed_name", "field_name").distinct())


def nested_changes(raw: DataFrame, changes: DataFrame) -> DataFrame:
    """The columns of ``schema_changes`` and ``path``: changes below the fields that a file has kept or renamed.

    A path is added, removed or retyped; what lies below an added or removed field goes with it.
    ``changes`` are those of the fields themselves."""
    key = ["feed_name", "file_seq"]
    found = tagged_paths(parsed_lines(raw)).filter("path != ''").groupBy(*key, "field_name", "path")
    types = found.agg(F.sort_array(F.collect_set(F.nullif("json_type", F.lit("null")))).alias("types"))
    steps = _steps(raw)
    new = steps.join(types.withColumnRenamed("types", "new_types"), key).select(*key, "field_name", "path", "new_types")
    was = types.select("feed_name", F.col("file_seq").alias("before"), F.col("field_name").alias("was_name"), "path", F.col("types").alias("old_types"))
    renamed = changes.filter("change_kind = 'renamed'").select(*key, F.col("old_name").alias("was_name"), "field_name", "old_name")
    old = steps.join(was, ["feed_name", "before"]).join(renamed, [*key, "was_name"], "left")
    old = old.select(*key, F.coalesce("field_name", "was_name").alias("field_name"), "path", "old_name", "old_types")
    whole = changes.filter("change_kind in ('added', 'removed')").select(*key, "field_name")
    both = new.join(old, [*key, "field_name", "path"], "full").join(whole, [*key, "field_name"], "left_anti")
    kind = F.when(F.col("old_types").isNull(), "added").when(F.col("new_types").isNull(), "removed").when(F.col("old_types") != F.col("new_types"), "retyped")
    changed = both.withColumn("change_kind", kind).filter("change_kind is not null")
    return changed.join(steps.select(*key, "file_name"), key).select(*key, "file_name", "field_name", "path", "old_name", "change_kind", "old_types", "new_types")


def role_names(known_of: Inference) -> DataFrame:
    """(feed_name, field_name, role, evidence): the names besides those of ROLE_NAMES that carry a role in a feed.

    A name takes the role of the names it was renamed from or to most often in its own feed (evidence
    ``own``), step by step along chains of renames until no name gains a role; ties go to the smaller
    role. A name without such evidence takes the role that all feeds with evidence agree on (``others``);
    where they disagree it has none. All of it is one row per feed and name, in tables.
    """
    space = Workspace(known_of.fields.sparkSession, "roles")
    pairs = known_of.changes.filter("change_kind = 'renamed'").groupBy("feed_name", "old_name", "field_name").agg(F.count("*").alias("k"))
    both = pairs.select("feed_name", F.col("old_name").alias("name"), F.col("field_name").alias("other"), "k").unionByName(pairs.select("feed_name", F.col("field_name").alias("name"), F.col("old_name").alias("other"), "k"))
    links = space.save(both.filter(_role(F.col("name")).isNull()), "links")
    own = space.save(links.select("feed_name", "name", F.lit("").alias("role")).limit(0), "own-0")
    i, fresh = 0, None
    while fresh is None or not fresh.isEmpty():
        known = own.select("feed_name", F.col("name").alias("other"), "role")
        reached = links.join(known, ["feed_name", "other"], "left").withColumn("role", F.coalesce("role", _role(F.col("other")))).filter("role is not null")
        votes = reached.join(own, ["feed_name", "name"], "left_anti").groupBy("feed_name", "name", "role").agg(F.sum("k").alias("k"))
        first = F.row_number().over(Window.partitionBy("feed_name", "name").orderBy(F.desc("k"), "role"))
        fresh = space.save(votes.withColumn("x", first).filter("x = 1").select("feed_name", "name", "role"), f"fresh-{i}")
        own, i = space.save(own.unionByName(fresh), f"own-{i + 1}"), i + 1
    agreed = own.groupBy("name").agg(F.min("role").alias("role"), F.max("role").alias("most")).filter("role = most").select("name", "role")
    met = known_of.fields.withColumnRenamed("field_name", "name")
    lent = met.filter(_role(F.col("name")).isNull()).join(own, ["feed_name", "name"], "left_anti").join(agreed, "name").select("feed_name", "name", "role", F.lit("others").alias("evidence"))
    return own.withColumn("evidence", F.lit("own")).unionByName(lent).withColumnRenamed("name", "field_name")


def line_counts(raw: DataFrame) -> DataFrame:
    """(feed_name, file_seq, file_name, lines, well_formed, malformed) of every file; only well-formed lines become records."""
    good = F.count("v")
    return parsed_lines(raw).groupBy("feed_name", "file_seq", "file_name").agg(F.count("*").alias("lines"), good.alias("well_formed"), (F.count("*") - good).alias("malformed"))


def _flag(value: Column) -> Column:
    return F.coalesce(F.lower(canonical_text(value)) == "true", F.lit(False))


def _whole(value: Column) -> Column:
    """A number as it is, other values if their text is a whole number; else null."""
    kind, text = json_type(value), canonical_text(value)
    return F.when((kind == "number") | ((kind != "boolean") & text.rlike(INTEGER_TEXT)), text.try_cast("decimal(38,6)"))


def _branches(value: Column) -> Column:
    """JSON type, canonical text and typed branches of a variant."""
    kind, plain = json_type(value), F.try_variant_get(value, "$", "string")
    digits = F.length(F.regexp_replace(F.regexp_replace(plain, "[eE].*$", ""), r"^[-0.]+|[-.]", ""))
    long = kind.isin("object", "array") | ((kind == "number") & (digits > 15))
    return F.struct(
        kind.alias("kind"),
        canonical_text(value).alias("text"),
        F.when(kind == "string", plain).alias("string"),
        F.when(kind == "number", F.try_variant_get(value, "$", "double")).alias("number"),
        F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean")).alias("boolean"),
        F.when(long, F.to_json(value)).alias("json"),
    )


def unified_records(raw: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One consistent table of all well-formed lines: the canonical value of each role and its typed branches.

    ``names`` are further names per feed as ``role_names`` gives them; those of ROLE_NAMES hold everywhere
    and go first. Of several names of a role on one line the first whose value isn't null is read; of the
    flag the first that is true, if any is, and of the votes the first that isn't 0, if any is. A bad or missing value takes
    the role's default (rating 0.0, votes 0, flag false, timestamp 0): numbers are truncated to whole ones,
    text must be a whole number for votes and timestamp; a flag is true or the text "true" in any case.
    An array or object counts as its canonical text.

    The delivered value is in the branch of its JSON type, ``..._string``, ``..._number`` (double),
    ``..._boolean`` or ``..._json`` (objects and arrays as JSON text); numbers of more than 15 digits are in
    ``..._json`` too. ``..._type`` is the JSON type and ``..._name`` the field it was delivered in. Rows are not
    merged: a repeated line comes out repeatedly. Malformed lines are counted by ``line_counts``.
    """
    parsed = parsed_lines(raw).filter(F.col("v").isNotNull()).withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    if names is None:
        parsed = parsed.withColumn("more", F.lit(None).cast("map<string,array<string>>"))
    else:
        listed = names.groupBy("feed_name", "role").agg(F.array_sort(F.collect_list(F.struct(F.col("evidence") != "own", "field_name"))).alias("l"))
        per_role = F.struct("role", F.transform("l", lambda x: x["field_name"]).alias("names"))
        more = listed.groupBy("feed_name").agg(F.map_from_entries(F.collect_list(per_role)).alias("more"))
        parsed = parsed.join(Workspace(raw.sparkSession, "names").save(more, "more"), "feed_name", "left")

    def pick_name(role: str) -> Column:
        all_names = F.concat(F.array(*map(F.lit, ROLE_NAMES[role])), F.coalesce(F.element_at("more", role), F.array().cast("array<string>")))
        there = F.filter(all_names, lambda n: F.coalesce(F.schema_of_variant(F.element_at("m", n)) != "VOID", F.lit(False)))
        wanted = {"verified_purchase": lambda n: _flag(F.element_at("m", n)), "helpful_votes": lambda n: F.coalesce(_whole(F.element_at("m", n)).try_cast("int") != 0, F.lit(False))}.get(role)
        first = F.get(there, 0)
        return first if wanted is None else F.when(F.size(there) < 2, first).otherwise(F.coalesce(F.get(F.filter(there, wanted), 0), first))

    at = ["feed_name", "file_name", "file_seq", "line_no"]
    named = parsed.select(*at, "m", *[pick_name(r).alias(f"{r}_name") for r in ROLE_NAMES])
    valued = named.select(*at, *[f"{r}_name" for r in ROLE_NAMES], *[F.element_at("m", F.col(f"{r}_name")).alias(f"{r}_value") for r in ROLE_NAMES])
    chosen = valued.select("*", *[_branches(F.col(f"{r}_value")).alias(r) for r in ROLE_NAMES])
    b = lambda r: F.col(r)
    zero = lambda to: F.lit(0).cast(to)
    return chosen.select(
        *at,
        b("user_id")["text"].alias("user_id"),
        b("product_id")["text"].alias("product_id"),
        b("review_text")["text"].alias("review_text"),
        F.coalesce(F.when(b("rating")["kind"] != "boolean", b("rating")["text"].try_cast("double")), F.lit(0.0)).alias("rating"),
        to_seconds(F.coalesce(_whole(F.col("timestamp_value")).try_cast("bigint"), zero("bigint"))).alias("timestamp"),
        _flag(F.col("verified_purchase_value")).alias("verified_purchase"),
        F.coalesce(_whole(F.col("helpful_votes_value")).try_cast("int"), zero("int")).alias("helpful_votes"),
        *[b(r)["kind"].alias(f"{r}_type") for r in ROLE_NAMES],
        *[f"{r}_name" for r in ROLE_NAMES],
        *[b(r)[t].alias(f"{r}_{t}") for r in ROLE_NAMES for t in ("string", "number", "boolean", "json")],
    )
