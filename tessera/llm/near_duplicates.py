"""Texts that repeat others with small edits: a signature-coordinate inverted join.

Every distinct text gets a signature of coordinates, each the hash of two minhashes over its word
shingles. Texts are posted under each coordinate-value pair, which makes lists of texts; lists of one
text are skipped, in the others the collisions of every pair are counted, and pairs that collide in
enough coordinates are compared exactly on their shingle sets. A pair that counts collides in a second
list as well, so a long list isn't paired whole: its texts are posted again under each further list
they are in, and only what meets there is counted. That leaves out no pair that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.functions.text import clean_text
from tessera.llm import textgrams as G
from tessera.llm.components import connected_components
from tessera.operators.pairs import blocked_pairs, gathered_pairs
from tessera.shipping import ship_package
from tessera.storage import Workspace

#: Coordinates of a signature, at most.
MOST_COORDINATES = 64
#: Bytes of text that are compared at once, unless one pair alone has more.
COMPARED_BYTES = 1 << 22


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7_919).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """(row, coordinates) of texts (row, words) with at least one shingle: one 32-bit value per coordinate."""
    pairs = _multipliers(2 * coordinates)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in G.chunks(batch.column(1)):
                doc, _, h = c.grams(shingle)
                if not len(doc):
                    continue
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                who = doc[first]
                low = lambda a: np.minimum.reduceat(h * a, first)
                with np.errstate(over="ignore"):
                    values = [(G.mix(low(pairs[2 * k]) ^ G.mix(low(pairs[2 * k + 1]) + np.uint64(k))) >> np.uint64(32)).astype(np.uint32) for k in range(coordinates)]
                bounds = np.arange(0, len(who) * coordinates + 1, coordinates, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.stack(values, 1).ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who + c.first)), lists], ["row", "coordinates"])

    ship_package(texts.sparkSession)
    return texts.mapInArrow(emit, "row bigint, coordinates array<int>")


def colliding_pairs(signed: DataFrame, space: Workspace, match: int = 2, long_list: int = 40) -> DataFrame:
    """(a, b), a < b: pairs of texts that collide in at least ``match`` coordinates, all of them; ``match`` is at least 2.

    A list is numbered by coordinate and value. The sizes of lists are combined before the shuffle and the
    lists of several texts written, so postings are joined with a table and a hot list is split; what
    remains is small. Lists of up to ``long_list`` texts are gathered and paired. Texts of longer ones are
    paired where they share a further list too, which a pair of two collisions does.
    """
    if match < 2:
        raise ValueError("a pair needs two collisions at least")
    at = F.posexplode("coordinates").alias("k", "value")
    posted = signed.select("row", at).select("row", (F.col("value").cast("bigint") * MOST_COORDINATES + F.col("k")).alias("list"))
    lists = space.save(posted.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    live = space.save(posted.join(lists, "list"), "live")
    near = gathered_pairs(live.filter(F.col("n") <= long_list), ["list"], "row").select("item_a", "item_b", "list")
    crowded = live.filter(F.col("n") > long_list).select("row", F.col("list").alias("one"))
    other = live.select("row", F.col("list").alias("two"), (F.col("n") > long_list).alias("both"))
    # of two long lists the lesser comes first, so every couple of lists is looked at once
    couples = space.save(crowded.join(other, "row").filter("two != one and (not both or one < two)").select("row", "one", "two", "both"), "couples")
    met = blocked_pairs(couples, ["one", "two", "both"], "row")
    far = met.select("item_a", "item_b", F.explode(F.when(F.col("both"), F.array("one", "two")).otherwise(F.array("one"))).alias("list")).distinct()
    hits = near.unionByName(far).groupBy(F.col("item_a").alias("a"), F.col("item_b").alias("b")).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= match).select("a", "b")


def verified(pairs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs (a, b, words_a, words_b) whose sets of shingles, told apart by 64 bits, have the Jaccard ``similarity``."""
    num, den = similarity

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for c in G.chunks(texts):
            doc, _, h = c.grams(shingle)
            docs.append(doc + c.first)
            hashes.append(h)
        return G.distinct_grams(np.concatenate(docs), np.concatenate(hashes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)))
            begin = 0
            while begin < batch.num_rows:
                done = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, done + COMPARED_BYTES, side="right")))
                part = batch.slice(begin, end - begin)
                begin, n = end, end - begin
                (da, ha), (db, hb) = sets(part.column(2)), sets(part.column(3))
                either = np.bincount(G.distinct_grams(np.r_[da, db], np.r_[ha, hb])[0], minlength=n)
                shared = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - either
                kept = pa.array(np.flatnonzero((den * shared >= num * either) & (either > 0)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept)], ["a", "b"])

    ship_package(pairs.sparkSession)
    return pairs.mapInArrow(emit, "a bigint, b bigint")


@dataclass(frozen=True)
class Alike:
    """Links between different texts (rep_a < rep_b) and the ids of every text (rep, id), both written tables.

    A text is known by a number of its own, the least row number that carries it; ``copies`` are the members of texts of several rows."""

    links: DataFrame
    members: DataFrame
    copies: DataFrame
    space: Workspace


def _text_keys() -> dict[str, Column]:
    """128 bits of hash that tell texts apart."""
    return {"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words", F.lit(2))}


def similar_texts(
    reviews: DataFrame,
    id_column: str = "review_id",
    text_column: str = "review_text",
    shingle: int = 5,
    similarity: tuple[int, int] = (4, 5),
    min_words: int = 20,
    coordinates: int = 26,
    match: int = 2,
    long_list: int = 40,
) -> Alike:
    """Links between different texts whose sets of ``shingle``-word sequences have at least the Jaccard
    ``similarity`` (a fraction), and the ids of each text.

    Texts are compared cleaned. Ids must be bigint; null ids, null texts and texts below ``min_words`` words
    take no part. An id given several times with one text counts once; an id given with several texts
    takes part with each. Equal texts are found by 128-bit keys, so that copies, however many, are one text
    from then on; texts themselves are shuffled only for candidate pairs.

    A pair of similarity s collides in one coordinate with probability s * s. With 26 coordinates and 2
    matches a pair right at 0.6 is missed with probability 0.00014 and one at 0.7 with less than 0.000001;
    no other step loses pairs.
    """
    if not (0 < coordinates <= MOST_COORDINATES and 0 < shingle <= min_words):
        raise ValueError(f"1 to {MOST_COORDINATES} coordinates, and shingles no longer than the shortest text")
    space = Workspace(reviews.sparkSession, "alike")
    reviews = pick(reviews, id_column, text_column).toDF("id", "text")
    text = F.col("text")
    # no text of fewer characters has so many words; lower() first, since it can lengthen a text
    cleaned = reviews.filter(F.col("id").isNotNull() & (F.length(F.lower(text)) >= 2 * min_words - 1)).select(F.col("id").cast("bigint").alias("id"), clean_text(text).alias("words"))
    blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    long_enough = cleaned.filter(blanks >= min_words - 1).select("id", "words", *[h.alias(n) for n, h in _text_keys().items()])
    texts = space.save(long_enough.withColumn("row", F.monotonically_increasing_id()), "texts")

    copied = space.save(texts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("row").alias("rep")).filter("n > 1").drop("n"), "copied")
    copies = space.save(texts.select("h1", "h2", "row", "id").join(copied, ["h1", "h2"]).select("rep", "row", "id"), "copies")
    further = copies.filter("row != rep").select("row", "rep")
    members = texts.select("row", "id").join(further, "row", "left").select(F.coalesce("rep", "row").alias("rep"), "id")

    signed = space.save(signatures(texts.select("row", "words").join(further.select("row"), "row", "left_anti"), shingle, coordinates), "signed")
    pairs = space.save(colliding_pairs(signed, space, match, long_list), "pairs")
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    needed = space.save(texts.select("row", "words").join(space.save(ends, "ends"), "row", "left_semi"), "needed")
    one = pairs.join(needed.select(F.col("row").alias("a"), F.col("words").alias("words_a")), "a")
    both = one.join(needed.select(F.col("row").alias("b"), F.col("words").alias("words_b")), "b")
    links = verified(both.select("a", "b", "words_a", "words_b"), shingle, similarity).toDF("rep_a", "rep_b")
    return Alike(space.save(links, "links"), space.save(members.distinct(), "members"), copies, space)


def similar_pairs(alike: Alike) -> DataFrame:
    """(a, b), a < b: every pair of different ids with alike or equal texts."""
    left = alike.members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    right = alike.members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = alike.links.join(left, "rep_a").join(right, "rep_b").select("x", "y")
    same = alike.space.save(alike.copies.select("rep", "id").distinct(), "same")
    within = blocked_pairs(same, ["rep"], "id").select(F.col("item_a").alias("x"), F.col("item_b").alias("y"))
    return across.filter("x != y").unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_groups(alike: Alike, ids: DataFrame) -> DataFrame:
    """(id, group_id, n_links): one row per id in ``ids`` (one column), null ids left out: its group, named by
    the least id in it, and the number of other texts that its own text, or any of its texts, is linked to.

    An id whose text is like no other, or too short to be compared, is a group of its own with no link."""
    both = alike.links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("to")).unionByName(alike.links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("to")))
    degree = alike.space.save(both.groupBy("rep").agg(F.count("*").alias("n")), "degree")
    # texts linked by a pair, and the texts of one id, are in one group
    least = alike.members.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("most"))
    several = alike.space.save(least.filter("v != most").select("id", "v"), "several")
    shared = alike.members.join(several, "id").filter("rep != v").select(F.col("rep").alias("u"), "v")
    graph = alike.links.select(F.col("rep_b").alias("u"), F.col("rep_a").alias("v")).unionByName(shared).distinct()
    parts = alike.space.save(connected_components(graph).select(F.col("member").alias("rep"), "group_id"), "parts")
    placed = alike.members.join(parts, "rep", "left").join(degree, "rep", "left")
    rows = alike.space.save(placed.select("id", F.coalesce("group_id", "rep").alias("part"), F.coalesce("n", F.lit(0)).alias("n")), "placed")
    named = alike.space.save(rows.groupBy("part").agg(F.min("id").alias("group_id")), "named")
    compared = rows.join(named, "part").groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("n").alias("n_links"))
    every = ids.toDF("id").filter("id is not null").select(F.col("id").cast("bigint").alias("id")).distinct()
    return every.join(compared, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
