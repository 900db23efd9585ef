"""Pairs of members of a group, and weighted edges between users."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import PipelineConfig
from tessera.storage import Workspace

LIST = 256  # twins that one array holds
BUSY = 10_000  # groups of a user above which one task doesn't take all of the user's pairs

def gathered_pairs(rows: DataFrame, group: list[str], item: str = "item") -> DataFrame:
    """The pairs of ``blocked_pairs`` for groups whose size is known to be bounded: each is gathered as one
    array by one shuffle and paired from it, so that groups of one member end there."""
    gathered = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("all")).filter(F.size("all") > 1)
    led = gathered.select(*group, "all", F.posexplode("all").alias("at", "item_a"))
    return led.select(*group, "item_a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("item_b"))


def blocked_pairs(members: DataFrame, group: list[str], item: str, block_size: int = 512) -> DataFrame:
    """Every unordered pair of distinct items of a group, as ``item_a`` < ``item_b`` plus the group columns.

    ``members`` has distinct rows and is read three times, so it should be a written table. Sizes are
    combined before the shuffle; the keys of the groups above ``block_size``, no more than rows /
    ``block_size``, are written first. Smaller groups are gathered. A larger group is cut into ceil(n / block_size) blocks by a hash of
    the item and its join key holds a pair of blocks, so no task ever sees more than two blocks of it.
    Null items and null group keys pair with nothing.
    """
    keys = [F.col(g) for g in group]
    rows = members.select(*keys, F.col(item).alias("item")).na.drop()
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > block_size)
    big = Workspace(members.sparkSession, "big-groups").save(sizes.select(*group, F.ceil(F.col("n") / F.lit(block_size)).cast("int").alias("blocks")), "big")

    small = gathered_pairs(rows.join(big, group, "left_anti"), group)

    # both sides of this join are read from tables, so the adaptive planner splits a hot group's rows
    placed = rows.join(big, group).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    last = F.col("blocks") - 1
    left = placed.select(*group, F.col("item").alias("x"), F.col("block").alias("bx"), F.explode(F.sequence("block", last)).alias("by"))
    right = placed.select(*group, F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("bx"), F.col("block").alias("by"))
    large = (
        left.join(right, [*group, "bx", "by"])
        .filter((F.col("bx") < F.col("by")) | (F.col("x") < F.col("y")))
        .select(*group, F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    )
    return small.unionByName(large)


def group_members(groups: DataFrame) -> DataFrame:
    """Distinct users of each group."""
    return groups.filter(F.col("user_id").isNotNull()).select("product_id", "bucket", "user_id").distinct()


def user_pairs(groups: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(user_a, user_b, product_id, bucket): each unordered pair of users once per group, user_a < user_b."""
    members = Workspace(groups.sparkSession, "members").save(group_members(groups), "members")
    pairs = blocked_pairs(members, ["product_id", "bucket"], "user_id", config.pair_block_size)
    return pairs.select(F.col("item_a").alias("user_a"), F.col("item_b").alias("user_b"), "product_id", "bucket")


def counted_pairs(members: DataFrame, group: list[str], item: str, least: int, space: Workspace, busy: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(item_a, item_b, weight): pairs of items that share at least ``least`` groups.

    ``members`` is a written table of distinct rows without nulls. Counts are combined before the shuffle. Where
    the groups hold more than ``pairs_per_round`` pairs, the result is a table in ``space``, made in rounds by a hash of the
    lesser item: a pair falls into exactly one round, so each count is whole, and only one round's shuffle is on disk
    at a time. What is shuffled then is an item with the array of those it meets in a group, in place of
    its pairs; they come to be, and are counted, behind the shuffle. ``busy`` is a table of items in so many groups that
    all their pairs are too much for one task; these are shuffled one by one.
    """
    sizes = space.save(members.groupBy(*group).agg(F.count("*").cast("double").alias("n")), "sizes")
    total = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    if total <= config.pairs_per_round:
        pairs = blocked_pairs(members, group, item, config.pair_block_size)
        return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    rounds = math.ceil(total / config.pairs_per_round)
    rows = members.select(*group, F.col(item).alias("item"))
    big = space.save(sizes.filter(F.col("n") > config.pair_block_size).select(*group), "big")
    # an array is made behind the shuffle only: before it, tasks hold few members of a group
    small = rows.join(big, group, "left_anti").repartition(*group).groupBy(*group).agg(F.sort_array(F.collect_list("item")).alias("all"))
    gathered = space.save(small.select("all").filter(F.size("all") > 1), "gathered")
    large = space.save(rows.join(big, group), "large")
    space.release()
    any_large, any_busy = not big.isEmpty(), not busy.isEmpty()

    def met(i: int) -> DataFrame:
        """(item_a, items, spread): what the lesser items of a round meet in each group."""
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == i
        led = gathered.select("all", F.posexplode("all").alias("at", "item_a")).filter(own("item_a") & (F.col("at") + 1 < F.size("all")))
        led = led.select("item_a", F.slice("all", F.col("at") + 2, F.size("all")).alias("items"))
        if any_large:
            # both sides of this join are read from tables, so the adaptive planner splits a hot group's rows
            lead = large.select(*group, F.col("item").alias("item_a")).filter(own("item_a"))
            pairs = lead.join(large.select(*group, F.col("item").alias("item_b")), group).filter("item_a < item_b")
            led = led.unionByName(pairs.select("item_a", F.array("item_b").alias("items")))
        led = led.withColumn("spread", F.lit(0))
        if not any_busy:
            return led
        keys = busy.select(F.col(item).alias("item_a"))
        one = led.join(keys, "item_a").select("item_a", F.explode("items").alias("item_b"))
        one = one.select("item_a", F.array("item_b").alias("items"), F.hash("item_b").alias("spread"))
        return led.join(keys, "item_a", "left_anti").unionByName(one)

    done = []
    for i in range(rounds):
        pairs = met(i).repartition("item_a", "spread").select("item_a", "spread", F.explode("items").alias("item_b"))
        counted = pairs.groupBy("item_a", "spread", "item_b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
        space.save(counted.select("item_a", "item_b", "weight"), f"round-{i}")
        space.release()
        done.append(space.path(f"round-{i}"))
    for table in ("gathered", "large"):
        space.drop(table)
    kind = members.schema[item].dataType
    schema = T.StructType([T.StructField("item_a", kind), T.StructField("item_b", kind), T.StructField("weight", T.LongType())])
    return members.sparkSession.read.schema(schema).parquet(*done)


@dataclass(frozen=True)
class TwinEdges:
    """All edges, with users that are in exactly the same groups ("twins") stood for by the least of them.

    Twins have the same edges with the same weights, and an edge to each other whose weight is the number of
    their groups. So the edges between the least users, and the twins, hold the whole graph: n twins
    cost n rows instead of the pairs of n with everything they meet. Both are written tables.
    """

    found: DataFrame  # user_a, user_b, weight: the edges between least users
    twins: DataFrame  # user_id, rep (the least twin), groups (how many), size (how many twins)
    alone: bool  # no user has a twin, so ``found`` holds all edges

    def lists(self) -> DataFrame:
        """(rep, users): twins in arrays of about ``LIST`` at most, so that a large set of twins isn't one row."""
        part = F.pmod(F.xxhash64("user_id"), F.ceil(F.col("size") / F.lit(LIST)))
        return self.twins.groupBy("rep", part.alias("part")).agg(F.collect_list("user_id").alias("users")).select("rep", "users")

    def across(self, found: DataFrame) -> DataFrame:
        """``found`` with one row (x, y) for each pair of a twin x of user_a and a twin y of user_b.

        Arrays of twins travel through the joins; pairs come to be after the last shuffle."""
        lists = self.lists()
        rest = [c for c in found.columns if c not in ("user_a", "user_b")]
        near = found.join(lists.select(F.col("rep").alias("user_a"), F.col("users").alias("xs")), "user_a")
        both = near.join(lists.select(F.col("rep").alias("user_b"), F.col("users").alias("ys")), "user_b")
        return both.select(*rest, "ys", F.explode("xs").alias("x")).select(*rest, "x", F.explode("ys").alias("y"))

    def edges(self) -> DataFrame:
        """(user_a, user_b, weight) of all users."""
        if self.alone:
            return self.found
        between = self.across(self.found).select(F.least("x", "y").alias("user_a"), F.greatest("x", "y").alias("user_b"), "weight")
        within = blocked_pairs(self.twins.filter(F.col("size") > 1), ["rep", "groups"], "user_id")
        return between.unionByName(within.select(F.col("item_a").alias("user_a"), F.col("item_b").alias("user_b"), F.col("groups").alias("weight")))


def twin_edges(groups: DataFrame, config: PipelineConfig = PipelineConfig(), rounds: int = 1, spent: Workspace | None = None) -> TwinEdges:
    """The graph of pairs seen in at least ``min_repeated_groups`` groups.

    A user in fewer groups than that can't have an edge; such users leave before pairing. Sets of groups are
    compared by their size and two 64-bit hashes of each group, combined by exclusive or. Only the least of
    the users with one set is paired. A pair occurs once per group, so its weight is a plain count.
    What is read several times is written once, and a join of two tables is split where a key is hot.
    Least users are paired by numbers in the order of their ids.
    Members and sets are made in ``rounds`` rounds, by the column ``round`` of ``groups`` if there are several, so that
    only one round's shuffle is on disk at a time. ``spent`` is what ``groups`` is read from; it is deleted once members are written.
    """
    spark = groups.sparkSession
    space = Workspace(spark, "members")
    whole = groups.filter(F.col("product_id").isNotNull() & F.col("bucket").isNotNull())
    of_round = lambda df, i: df.filter(F.col("round") == i) if rounds > 1 else df
    members = space.save_rounds([group_members(of_round(whole, i)) for i in range(rounds)], "members")
    if spent is not None:
        spent.close()
    sets = [
        spark.read.schema(members.schema).parquet(space.path(f"members-{i}")).groupBy("user_id").agg(
            F.count("*").alias("groups"), F.bit_xor(F.xxhash64("product_id", "bucket")).alias("one"), F.bit_xor(F.xxhash64("bucket", "product_id")).alias("two")
        )
        for i in range(rounds)
    ]
    sets = space.save_rounds([s.filter(F.col("groups") >= config.min_repeated_groups) for s in sets], "sets")
    same = ["groups", "one", "two"]
    least = sets.groupBy(*same).agg(F.min("user_id").alias("rep"), F.count("*").alias("size"))
    least = space.save(least.orderBy("rep").withColumn("number", F.monotonically_increasing_id()), "least")
    twins = space.save(sets.join(least, same).select("user_id", "rep", "groups", "size"), "twins")
    kept = space.save(members.join(least.select(F.col("rep").alias("user_id"), "number"), "user_id").select("product_id", "bucket", "number"), "kept")
    for table in [f"{t}-{i}" for t in ("members", "sets") for i in range(rounds)]:
        space.drop(table)
    space.release()
    counting = Workspace(spark, "counted")
    busy = counting.save(least.filter(F.col("groups") > BUSY).select("number"), "busy")
    found = counted_pairs(kept, ["product_id", "bucket"], "number", config.min_repeated_groups, counting, busy, config)
    for end in "ab":
        found = found.join(least.select(F.col("number").alias(f"item_{end}"), F.col("rep").alias(f"user_{end}")), f"item_{end}")
    found = space.save(found.select("user_a", "user_b", "weight"), "found")
    for table in ("kept", "least"):
        space.drop(table)
    counting.close()
    space.release()
    return TwinEdges(found, twins, twins.filter(F.col("size") > 1).isEmpty())


def edges(groups: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(user_a, user_b, weight): pairs seen in at least ``min_repeated_groups`` groups."""
    return twin_edges(groups, config).edges()
