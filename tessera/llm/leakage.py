"""Evaluation passages inside a corpus: prefix-filtered containment of word windows.

A document contains ``window`` consecutive words of an item exactly if it contains all shingles of one
of the item's windows, in a row. So each window needs only its rarest shingle as prefix: documents
without it can't match. Rarity is counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import pick
from tessera.llm import textgrams as G
from tessera.shipping import ship_package
from tessera.storage import Workspace

#: Bits of the filter of item shingles that goes to the workers, a multiple of PIECE: 2 MB, however many items there are.
FILTER_BITS = 1 << 24
#: Fixed value: bits of one bitmap of the built-in aggregate.
PIECE = 32_768


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, joined by single blanks; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingle_filter(known: DataFrame, bits: int) -> np.ndarray:
    """One truth value per remainder of a shingle by ``bits``: whether some shingle in ``known`` has it.

    Built as bitmaps by the executors; bits / PIECE rows of 4 KB reach the driver."""
    at = F.pmod("shingle", F.lit(bits))
    pieces = known.groupBy(F.floor(at / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(at % PIECE).alias("bitmap"))
    out = np.zeros(bits, bool)
    for piece, bitmap in pieces.collect():
        out[piece * PIECE : (piece + 1) * PIECE] = np.unpackbits(np.frombuffer(bytes(bitmap), np.uint8), bitorder="little")
    return out


def shingles(texts: DataFrame, shingle: int, keep: np.ndarray | None = None) -> DataFrame:
    """(id, version, pos, shingle) of the shingles of ``texts`` (id, words); only those that pass the filter ``keep`` if given.

    ``version`` is a hash of the words: it tells apart different texts under one id, and is the same for repeated rows."""
    packed = None if keep is None else np.packbits(keep)
    bits = None if keep is None else np.uint64(len(keep))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if packed is None else np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids, versions = batch.column(0), batch.column(2)
            for c in G.chunks(batch.column(1)):
                doc, pos, h = c.grams(shingle)
                if passes is not None:
                    found = np.flatnonzero(passes[(h % bits).astype(np.int64)])
                    doc, pos, h = doc[found], pos[found], h[found]
                if len(doc):
                    at = pa.array(doc + c.first)
                    yield pa.RecordBatch.from_arrays([ids.take(at), versions.take(at), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], ["id", "version", "pos", "shingle"])

    ship_package(texts.sparkSession)
    return texts.select("id", "words", F.xxhash64("words").alias("version")).mapInArrow(emit, "id bigint, version bigint, pos int, shingle bigint")


def leaked(documents: DataFrame, items: DataFrame, window: int = 12, shingle: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, matched_words): documents holding at least ``window`` consecutive words of an item,
    with the length in words of the longest such run.

    Both tables need a bigint id and ``text``. Null and empty texts and items shorter than ``window`` words
    match nothing. A repeated row counts once; several texts under one id are matched each by itself, and
    the id has what any of them has. One pass over the documents keeps the positions of shingles that pass a
    filter of fixed size; those that occur in an item, usually a small part, are joined with the items'
    shingles, and everything after works on these positions. The more shingles the items have, the more
    pass the filter; the join tells them apart, so the rows don't depend on ``filter_bits``, a power of two
    of at least PIECE.
    """
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has 1 to window words")
    if filter_bits < PIECE or filter_bits & (filter_bits - 1):
        raise ValueError(f"the filter has a power of two of bits, at least {PIECE}")
    documents, items = pick(documents, "doc_id", "text"), pick(items, "item_id", "text")
    space = Workspace(documents.sparkSession, "leakage")
    span = window - shingle + 1  # shingles of a window
    item_words = items.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("id"), plain_words(F.col("text")).alias("words"))
    item, doc = ["item_id", "item_version"], ["doc_id", "doc_version"]
    own = space.save(shingles(item_words.distinct(), shingle).toDF(*item, "item_pos", "shingle"), "items")
    texts = documents.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), plain_words(F.col("text")).alias("words"))
    known = space.save(own.select("shingle").distinct(), "known")
    found = shingles(texts, shingle, shingle_filter(known, filter_bits)).join(known, "shingle", "left_semi")
    # distinct only here, where repeated documents are small
    hits = space.save(found.select("id", "version", "pos", "shingle").toDF(*doc, "doc_pos", "shingle").distinct(), "hits")

    # rarity over the whole corpus; a window with an absent shingle can't occur
    rarity = space.save(hits.select("doc_id", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("n_docs")), "rarity")
    order = Window.partitionBy(*item).orderBy("item_pos").rowsBetween(0, span - 1)
    ranked = own.join(rarity, "shingle", "left").withColumn("present", F.count("n_docs").over(order))
    rarest = ranked.withColumn("prefix", F.min(F.struct("n_docs", "shingle", "item_pos")).over(order)).filter(F.col("present") == span)
    prefixes = rarest.select(*item, F.col("item_pos").alias("window_at"), F.col("prefix.shingle").alias("shingle"), F.col("prefix.item_pos").alias("prefix_at"))

    # necessary prefix: the diagonal of document and item position fixes where the window has to start
    starts = (
        hits.join(prefixes, "shingle")
        .withColumn("doc_at", F.col("doc_pos") - (F.col("prefix_at") - F.col("window_at")))
        .filter("doc_at >= 0")
        .select(*doc, *item, "doc_at", "window_at")
        .distinct()
    )
    # exact containment: all shingles of the item-sized window, at their places
    needed = own.select(*item, "item_pos", F.col("shingle").alias("must"))
    spread = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).select(
        *doc, *item, "doc_at", "window_at", (F.col("window_at") + F.col("step")).alias("item_pos"), (F.col("doc_at") + F.col("step")).alias("doc_pos")
    )
    checked = (
        spread.join(needed, [*item, "item_pos"])
        .join(hits.select(*doc, "doc_pos", F.col("shingle").alias("must")), [*doc, "doc_pos", "must"])
        .groupBy(*doc, *item, "doc_at", "window_at")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == span)
    )
    # consecutive windows on one diagonal form a longer run
    diagonal = Window.partitionBy(*doc, *item, F.col("doc_at") - F.col("window_at")).orderBy("doc_at")
    runs = checked.withColumn("run", F.col("doc_at") - F.row_number().over(diagonal))
    lengths = runs.groupBy(*doc, *item, (F.col("doc_at") - F.col("window_at")).alias("d"), "run").agg((F.count("*") + window - 1).alias("words"))
    return lengths.groupBy("doc_id", "item_id").agg(F.max("words").alias("matched_words"))
