"""Items that appear together: an incrementally maintained pair table.

State lives in a folder of hash-bucketed Parquet tables: basket memberships, item marginals and pair
counts. A batch of changes touches the baskets it names; these emit signed deltas for items and pairs,
which are merged into the buckets they hash to. Other buckets are neither read nor written. A manifest
per version names the files of each bucket and is written last, so a batch that fails at any point
leaves the former state; files that neither the newest nor the version before names are deleted then.

The counts of all pairs are kept. ``min_support`` and ``lift`` only choose among them what counts as
associated, so tables may be read under other values than they were written under.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.functions.timebuckets import time_bucket, to_seconds
from tessera.operators.pairs import blocked_pairs
from tessera.storage import Workspace

#: Rows of a bucket that one task writes to one file, about; memberships of a new table per bucket; buckets at least and at most.
ROWS_PER_FILE = 2_000_000
MEMBERS_PER_BUCKET = 2_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 4_096

_TABLES = {
    "members": ("owner string, day bigint, item string", ["owner", "day"]),
    "marginals": ("item string, n bigint", ["item"]),
    "pairs": ("item_a string, item_b string, n bigint", ["item_a", "item_b"]),
}


def user_day_baskets(reviews: DataFrame) -> DataFrame:
    """(owner, day, item): distinct products a user reviews on one UTC day.

    Null and empty users and products are no keys; times of zero or below, or null, have no day."""
    reviews = pick(reviews, "user_id", "product_id", "timestamp")
    seconds = to_seconds(F.col("timestamp"))
    rows = reviews.filter((F.col("user_id") != "") & (F.col("product_id") != "") & (seconds > 0))
    return rows.select(F.col("user_id").alias("owner"), time_bucket(seconds, 24).alias("day"), F.col("product_id").alias("item")).distinct()


class PairTable:
    """Persistent pair counts under ``root``; ``apply`` brings in a batch of changes.

    Without ``root`` the table is one of the application's intermediate tables and goes with them. Without
    ``buckets`` a stored table keeps its own number and a new one takes it from its first batch."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, min_support: int = 5, lift: int = 4, block_size: int = 512):
        self.spark, self.buckets, self.min_support, self.lift, self.block_size = spark, buckets, min_support, lift, block_size
        self.space = Workspace(spark, "pair-table", root)
        self.version, self.baskets = 0, 0
        self.files: dict[str, dict[str, str]] = {t: {} for t in _TABLES}
        self.before: dict[str, dict[str, str]] = {t: {} for t in _TABLES}
        self._load()

    # --- state -----------------------------------------------------------------

    def _fs(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.space.path(name) if name else self.space.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _versions(self) -> list[int]:
        """Versions whose manifest was written to the end."""
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))
        return [v for v in found if fs.exists(self._fs(f"manifest-{v}/_SUCCESS")[1])]

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(self.space.path(f"manifest-{version}")).first()[0])

    def _load(self) -> None:
        versions = self._versions()
        if versions:
            state = self._manifest(versions[-1])
            for given, kept in (("buckets", self.buckets or state["buckets"]), ("pairs", "all")):  # earlier tables lack pairs of rare and of frequent items
                if state.get(given) != kept:
                    raise ValueError(f"the table at {self.space.root} has {given}={state.get(given)}")
            self.buckets, self.version, self.baskets, self.files = state["buckets"], state["version"], state["baskets"], state["files"]
            if len(versions) > 1:
                self.before = self._manifest(versions[-2])["files"]

    def _commit(self, version: int, baskets: int, files: dict[str, dict[str, str]]) -> None:
        """Write the manifest of the new version, take it as the present state and delete what only older versions name."""
        state = {"version": version, "baskets": baskets, "files": files, "buckets": self.buckets, "pairs": "all"}
        self.spark.range(1).select(F.lit(json.dumps(state)).alias("value")).coalesce(1).write.mode("overwrite").text(self.space.path(f"manifest-{version}"))
        older = {p for t in _TABLES for p in self.before[t].values()} - {p for f in (files, self.files) for t in _TABLES for p in f[t].values()}
        self.before, self.version, self.baskets, self.files = self.files, version, baskets, files
        for path in older:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        for v in self._versions()[:-2]:
            self.space.drop(f"manifest-{v}")

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*_TABLES[table][1]), F.lit(self.buckets)).cast("int")

    def read(self, table: str, only: set[str] | None = None) -> DataFrame:
        """A table of the present state, or of some of its buckets."""
        schema, _ = _TABLES[table]
        paths = sorted({p for b, p in self.files[table].items() if only is None or b in only})
        if not paths:
            return self._empty(table)
        return self.spark.read.schema(schema).parquet(*paths)

    def _store(self, table: str, rows: DataFrame, touched: set[str], most: int) -> dict[str, str]:
        """Write the buckets ``touched`` anew, one directory per bucket, and return the places of all buckets.

        ``most`` is at least the number of rows; a bucket is spread over as many tasks as its share needs."""
        schema, keys = _TABLES[table]
        columns = [c.split()[0] for c in schema.split(", ")]
        name = f"{table}-v{self.version + 1}"
        parts = max(1, -(-most // (max(1, len(touched)) * ROWS_PER_FILE)))
        part = F.pmod(F.xxhash64(F.lit(parts), *keys), F.lit(parts))
        placed = rows.select(*columns, self._bucket(table).alias("bucket")).repartition("bucket", part)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self.space.path(name))
        fs, path = self._fs(name)
        made = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if "=" in s.getPath().getName()}
        kept = {b: p for b, p in self.files[table].items() if b not in touched}
        return kept | {b: f"{self.space.path(name)}/bucket={b}" for b in made}

    def _empty(self, table: str) -> DataFrame:
        columns = [c.split() for c in _TABLES[table][0].split(", ")]
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])

    def _buckets_of(self, table: str, rows: DataFrame) -> dict[str, int]:
        """The buckets that rows of ``table`` fall in, with their number of rows."""
        return {str(b): n for b, n in rows.groupBy(self._bucket(table).alias("b")).agg(F.count("*")).collect()}

    # --- changes -----------------------------------------------------------------

    def apply(self, present: DataFrame | None = None, absent: DataFrame | None = None) -> None:
        """Add the memberships ``present`` and take out those in ``absent``, both (owner, day, item).

        Baskets are sets: what is there already adds nothing, what isn't there takes nothing out. A
        membership in both is taken out. Rows with a null column are ignored. Empty batches change nothing.
        """
        run = Workspace(self.spark, "pair-batch")
        empty = self._empty("members")
        clean = lambda df: (empty if df is None else df.select("owner", "day", "item")).na.drop()
        change = clean(present).withColumn("is", F.lit(1)).unionByName(clean(absent).withColumn("is", F.lit(0))).groupBy("owner", "day", "item").agg(F.min("is").alias("is"))
        change = run.save(change, "change")
        first = not self.files["members"]
        size = change.count()
        if self.buckets is None:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // MEMBERS_PER_BUCKET)))
        if first:
            delta = run.save(change.filter("is = 1").withColumn("was", F.lit(0)), "delta")
            touched = {str(b) for b in range(self.buckets)}
            old_members = empty
        else:
            touched = set(self._buckets_of("members", change))
            old_members = self.read("members", touched)
            joined = change.join(old_members.withColumn("was", F.lit(1)), ["owner", "day", "item"], "left")
            delta = run.save(joined.withColumn("was", F.coalesce("was", F.lit(0))).filter(F.col("is") != F.col("was")), "delta")

        # signed marginals, combined before the shuffle; only the buckets they fall in are read
        shift = run.save(delta.groupBy("item").agg(F.sum(F.col("is") - F.col("was")).cast("bigint").alias("n")).filter("n != 0"), "shift")

        # a table, so that the members of a hot basket are split in the joins with it
        changed = run.save(delta.groupBy("owner", "day").agg(F.sum(F.col("is") - F.col("was")).alias("d")), "changed")
        if first:
            new_total = changed.count()
        else:
            size_before = old_members.join(changed.select("owner", "day"), ["owner", "day"], "left_semi").groupBy("owner", "day").agg(F.count("*").alias("k"))
            grown = changed.join(size_before, ["owner", "day"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
            born, died = grown.agg(F.sum((F.col("k") == 0).cast("int")), F.sum((F.col("k") + F.col("d") == 0).cast("int"))).first()
            new_total = self.baskets + (born or 0) - (died or 0)

        # changed baskets, as they were and as they are
        if first:
            views = delta.select("owner", "day", "item", F.lit(False).alias("was"), F.lit(True).alias("is"))
        else:
            before = old_members.join(changed.select("owner", "day"), ["owner", "day"], "left_semi").select("owner", "day", "item", F.lit(1).alias("was"), F.lit(1).alias("is"))
            both = before.unionByName(delta.select("owner", "day", "item", "was", "is"))
            # a delta row overrides the stored membership: min for those taken out, was 0 for new ones
            views = run.save(both.groupBy("owner", "day", "item").agg((F.max("was") == 1).alias("was"), (F.min("is") == 1).alias("is")), "views")
        pair_delta = run.save(self._signed_pairs(views), "pair-delta")

        # merge into the buckets concerned
        files = dict(self.files)
        left = old_members.join(delta.filter("is = 0"), ["owner", "day", "item"], "left_anti").unionByName(delta.filter("is = 1").select("owner", "day", "item"))
        files["members"] = self._store("members", left, touched, old_members.count() + size)
        for table, signed in (("marginals", shift), ("pairs", pair_delta)):
            keys = _TABLES[table][1]
            buckets = self._buckets_of(table, signed)
            old = self.read(table, set(buckets))
            merged = old.unionByName(signed).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n != 0")
            files[table] = self._store(table, merged, set(buckets), old.count() + sum(buckets.values()))
        self._commit(self.version + 1, new_total, files)
        self.touched = pair_delta.select("item_a", "item_b")
        self.moved = shift.select("item")

    def _signed_pairs(self, views: DataFrame) -> DataFrame:
        """(item_a, item_b, n): the change of each pair's count, from what the changed baskets held and hold.

        A large basket's pairs are made in blocks, so a basket of any size is spread over tasks; pairs of two
        members that stayed as they were give no row to the sum. ``views`` is a written table."""
        tagged = views.select("owner", "day", F.concat(F.when(F.col("was"), "1").otherwise("0"), F.when(F.col("is"), "1").otherwise("0"), "item").alias("item"))
        pairs = blocked_pairs(tagged, ["owner", "day"], "item", self.block_size)
        flag = lambda c, at: F.substring(c, at, 1) == "1"
        sign = (flag("item_a", 2) & flag("item_b", 2)).cast("int") - (flag("item_a", 1) & flag("item_b", 1)).cast("int")
        x, y = F.substring("item_a", 3, 1 << 30), F.substring("item_b", 3, 1 << 30)
        signed = pairs.select(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b"), sign.alias("d")).filter("d != 0")
        return signed.groupBy("item_a", "item_b").agg(F.sum("d").alias("n")).filter("n != 0")

    # --- results -----------------------------------------------------------------

    def scores(self, pairs: DataFrame | None = None) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, baskets, lift, npmi) of every pair with a common basket, or of ``pairs``.

        ``lift`` is the count over that expected by chance, ``npmi`` its logarithm normalised to [-1, 1]."""
        rows = self.read("pairs") if pairs is None else self.read("pairs").join(pairs, ["item_a", "item_b"], "left_semi")
        m = self.read("marginals")
        joined = rows.join(m.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(m.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        total = F.lit(self.baskets).cast("double")
        n_ab = F.col("n")
        lift = n_ab * total / (F.col("n_a").cast("double") * F.col("n_b"))
        npmi = F.when(n_ab == total, F.lit(1.0)).otherwise(F.log(lift) / -F.log(n_ab / total))
        return joined.select("item_a", "item_b", n_ab.alias("n_ab"), "n_a", "n_b", F.lit(self.baskets).cast("bigint").alias("baskets"), lift.alias("lift"), npmi.alias("npmi"))

    def associated(self) -> DataFrame:
        """Pairs in at least ``min_support`` common baskets and ``lift`` times as many as by chance, in integers.

        An item in more than a ``lift``-th of all baskets has no such pair; leaving it out first keeps the products small."""
        s = self.scores().filter(F.col("n_ab") >= self.min_support)
        possible = F.greatest("n_a", "n_b") * self.lift <= F.col("baskets")
        return s.filter(F.when(possible, F.col("n_ab") * F.col("baskets") >= self.lift * F.col("n_a") * F.col("n_b")).otherwise(False))


def changed_scores(table: PairTable) -> DataFrame:
    """Scores of the pairs that the last batch affected: their own count or an item's count changed."""
    pairs = table.read("pairs").select("item_a", "item_b")
    by_a = pairs.join(table.moved.withColumnRenamed("item", "item_a"), "item_a", "left_semi")
    by_b = pairs.join(table.moved.withColumnRenamed("item", "item_b"), "item_b", "left_semi")
    return table.scores(table.touched.unionByName(by_a).unionByName(by_b).distinct())


def review_pairs(reviews: DataFrame, buckets: int | None = None, late_share: float = 0.1) -> PairTable:
    """A pair table of user-day baskets, loaded in two batches: the rows that arrived first, then the latest tenth."""
    reviews = pick(reviews, "user_id", "product_id", "timestamp", "ingested_at")
    spark = reviews.sparkSession
    cut = reviews.agg(F.percentile_approx(F.unix_micros(F.col("ingested_at").cast("timestamp")), 1 - late_share, 1000)).first()[0]
    table = PairTable(spark, buckets=buckets)
    if cut is None:
        table.apply(user_day_baskets(reviews))
        return table
    late = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")) > cut, F.lit(True))
    table.apply(user_day_baskets(reviews.filter(~late)))
    table.apply(user_day_baskets(reviews.filter(late)))
    return table
