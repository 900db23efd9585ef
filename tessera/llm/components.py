"""One group identifier for all records linked directly or indirectly.

Alternating large-star and small-star rewrites of the edge set (Kiveris et al., Connected Components
in MapReduce and Beyond, 2014): every rewrite is one grouped minimum and one join with it,
and the number of rounds grows with the logarithm of the graph, not with the length of its chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.storage import Workspace


def links_of(edges: DataFrame, a: str = "user_a", b: str = "user_b", weight: str | None = "weight", min_weight: int = 3) -> DataFrame:
    """(u, v): distinct links with u > v. Null ends, self links and rows below ``min_weight`` (or without weight) link nothing."""
    edges = pick(edges, a, b, *([] if weight is None else [weight]))
    kept = edges if weight is None else edges.filter(F.col(weight) >= min_weight)
    x, y = F.col(a), F.col(b)
    return kept.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()


def least_below(links: DataFrame) -> DataFrame:
    """(w, m): the least smaller neighbour m of every w that has one, combined before the shuffle."""
    return links.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Connect every larger neighbour u of each v to the least of v and v's neighbours.

    Links hold u > v, so that least is ``least_below`` of v, or v itself; ``least`` is that table, written
    out. Rows may repeat."""
    return links.join(least, links.v == least.w, "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of each u, and u, to the least of them. Links hold u > v."""
    moved = links.join(least, links.u == least.w).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("w", "m")).distinct()


def _state(links: DataFrame) -> tuple:
    key: Column = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.bit_xor(key), F.sum(F.shiftright(key, 20))).first())


def _star_forest(links: DataFrame, space: Workspace, max_rounds: int) -> DataFrame:
    """(member, root) of every linked record, the root being the least member of its component."""
    now, name = space.save(links, "round-0"), "round-0"
    state = _state(now)
    for i in range(1, max_rounds + 1):
        below = space.save(least_below(now), f"below-{i}")
        half = space.save(large_star(now, below), f"half-{i}")
        under = space.save(least_below(half), f"under-{i}")
        new = space.save(small_star(half, under), f"round-{i}")
        after = _state(new)
        for old in (f"below-{i}", f"half-{i}", f"under-{i}", name):
            space.drop(old)
        now, name = new, f"round-{i}"
        if after == state:
            roots = now.select(F.col("v").alias("member")).distinct()
            return now.select(F.col("u").alias("member"), F.col("v").alias("root")).union(roots.select("member", F.col("member").alias("root")))
        state = after
    raise RuntimeError(f"the edges still change after {max_rounds} rounds")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(member, group_id): every linked record with the least identifier of its component.

    ``links`` has the columns u > v, of any ordered type; repeats do no harm. Identifiers that
    aren't bigint are stood for by 64-bit keys while edges are rewritten, which makes rows short and lets
    minima be kept in hash tables; keys are checked to be different for different identifiers, and
    chosen again if not. Each round and its table of minima are written to the shared folder and the ones
    before are deleted; so both sides of every join are read from tables, the one with the minima has one
    row per record, and the adaptive planner splits the links of a hub. An empty edge set gives an empty
    result. The loop ends when a round leaves the edges unchanged (same count and hashes); then they are
    stars around the least member.
    """
    space = Workspace(links.sparkSession, "stars")
    if links.schema["u"].dataType.typeName() == "long":
        return _star_forest(links, space, max_rounds).withColumnRenamed("root", "group_id")
    given = space.save(links.select("u", "v"), "given")
    ids = space.save(given.select(F.col("u").alias("id")).union(given.select("v")).distinct(), "ids")
    for seed in range(64):
        key = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        if ids.groupBy(key(F.col("id"))).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no keys tell the identifiers apart")
    x, y = key(F.col("u")), key(F.col("v"))
    forest = _star_forest(given.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")), space, max_rounds)
    named = space.save(ids.withColumn("member", key(F.col("id"))).join(space.save(forest, "forest"), "member").select("id", "root"), "named")
    least = space.save(named.groupBy("root").agg(F.min("id").alias("group_id")), "least")
    return named.join(least, "root").select(F.col("id").alias("member"), "group_id")
