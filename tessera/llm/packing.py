"""Filling containers of fixed capacity: best-fit decreasing with certified bounds.

Items are packed partition by partition. Dual feasible functions give a number of containers that no
packing can go below, for each partition and for all items together. While more containers than that are
in use, partitions exchange the contents of their containers with room left, a few partitions at a time
and others in each round; these are packed again, and the new packing is kept only where it needs fewer
containers. Containers that are full stay as they are and aren't read again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.shipping import ship_package
from tessera.storage import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before byte-pair merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A partition holds about so many containers' worth of tokens, and at most so many items.
CONTAINERS_PER_PARTITION = 2_000
ITEMS_PER_PARTITION = 200_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_sent: dict[tuple[str, str], str] = {}


def _send(spark: SparkSession, tokenizer: str) -> str:
    """Send the vocabulary file to the executors, once per application, and return the name it has there."""
    sent = (spark.sparkContext.applicationId, tokenizer)
    if sent not in _sent:
        spark.sparkContext.addFile(tokenizer)
        _sent[sent] = Path(tokenizer).name
    return _sent[sent]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have none.

    ``tokenizer`` is a vocabulary file of the driver, in the form of one base64 token and its rank per line."""
    name = _send(documents.sparkSession, tokenizer)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    ship_package(documents.sparkSession)
    return pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(emit, "doc_id bigint, n_tokens bigint")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): one row per document, or several if it exceeds the capacity;
    all pieces but the last then fill a container each. A document of no tokens is one piece of size 0."""
    number = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n_tokens") / F.lit(capacity)))
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)))
    start = F.col("piece") * capacity
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("n_tokens"))


def lower_bound(histogram: np.ndarray) -> int:
    """Containers that no packing can go below. ``histogram[s]`` items have size s; the capacity is its last index.

    The maximum over two families of dual feasible functions: for each e up to half the capacity, sizes above
    capacity - e count as full and sizes below e as nothing; and for each k, sizes rounded down to multiples of
    capacity / k after scaling by k + 1 (exact multiples stay)."""
    c = len(histogram) - 1
    s = np.arange(c + 1, dtype=np.int64)
    n = histogram.astype(np.int64)
    mass, count = np.concatenate([[0], np.cumsum(n * s)]), np.concatenate([[0], np.cumsum(n)])
    e = np.arange(0, c // 2 + 1)
    full = count[c + 1] - count[c - e + 1]
    between = mass[c - e + 1] - mass[np.minimum(e, c - e + 1)]
    best = int(np.max(full + -(-between // c)))
    for k in range(1, min(c, 20) + 1):
        scaled = (k + 1) * s
        f = np.where(scaled % c == 0, s * k, scaled // c * c)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-int((n * f).sum()) // (k * c))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, free room of each container). Sizes are at most the capacity.

    The free rooms in use are the bits of one integer, so the tightest container that still fits is the
    lowest set bit at or above the item's size."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                used ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        left = room - size
        free[b] = left
        if not open_at[left]:
            used |= 1 << left
        open_at[left].append(b)
        where[i] = b
    return where, np.array(free, np.int64)


_PACKED = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, part bigint, container bigint, free_room bigint"


def _packer(capacity: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece"], kind="stable")
        sizes = items["n_tokens"].to_numpy()
        where, free = best_fit_decreasing(sizes, capacity)
        return items[["doc_id", "piece", "first_token", "n_tokens", "part"]].assign(container=where, free_room=free[where])

    return pack


def _histogram(items: DataFrame, capacity: int) -> np.ndarray:
    """How many items have each size; sizes are counted before they reach the driver, so at most capacity + 1 rows do."""
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect():
        histogram[size] = n
    return histogram


def packed(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, rounds: int = 12, containers_per_partition: int = CONTAINERS_PER_PARTITION, exchange: int = 4) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id, free_room): every document once, or in pieces if
    it alone exceeds ``capacity``.

    Partitions come from a hash of the document and are sized by tokens and items, so none grows with the
    data. Each round puts ``exchange`` partitions together, others than the round before, gathers what lies in
    their containers that aren't full, packs that again and keeps it if it saves containers. It ends when
    the bound over all items is reached, when two rounds running save nothing, or after ``rounds``;
    ``certificate`` tells what is left open. Repeated documents are items like others.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    space = Workspace(documents.sparkSession, "packing")
    all_pieces = space.save(pieces(token_counts(documents, tokenizer), capacity), "pieces")
    histogram = _histogram(all_pieces, capacity)
    tokens, items, bound = int((histogram * np.arange(capacity + 1)).sum()), int(histogram.sum()), lower_bound(histogram)
    parts = max(1, -(-tokens // (capacity * containers_per_partition)), -(-items // ITEMS_PER_PARTITION))
    spread = all_pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    first = space.save(spread.groupBy("part").applyInPandas(_packer(capacity), _PACKED).withColumn("round", F.lit(0)), "packed-0")
    full, loose = [first.filter("free_room = 0")], first.filter("free_room > 0")
    boxes = lambda df: df.select("round", "part", "container").distinct()
    used, idle = boxes(first).count(), 0
    for r in range(1, rounds + 1):
        if used <= bound or idle == 2:
            break
        groups = max(1, -(-parts // exchange))
        mixing = loose.withColumn("mixed", F.pmod(F.xxhash64("round", "part", F.lit(r)), F.lit(groups)))
        was = boxes(mixing).join(mixing.select("round", "part", "mixed").distinct(), ["round", "part"]).groupBy("mixed").agg(F.count("*").alias("before"))
        again = mixing.select("doc_id", "piece", "first_token", "n_tokens", F.col("mixed").alias("part")).groupBy("part").applyInPandas(_packer(capacity), _PACKED)
        tried = space.save(again.withColumn("round", F.lit(r)), f"tried-{r}")
        now = boxes(tried).groupBy("part").agg(F.count("*").alias("after"))
        better = space.save(now.join(was, F.col("part") == F.col("mixed")).filter("after < before").select("mixed", (F.col("before") - F.col("after")).alias("saved")), f"better-{r}")
        saved = better.agg(F.coalesce(F.sum("saved"), F.lit(0))).first()[0]
        idle = 0 if saved else idle + 1
        if not saved:
            continue
        used -= saved
        new = tried.join(better.select(F.col("mixed").alias("part")), "part", "left_semi").select(*loose.columns)
        kept = mixing.join(better, "mixed", "left_anti").select(*loose.columns)
        full.append(new.filter("free_room = 0"))
        loose = space.save(kept.unionByName(new.filter("free_room > 0")), f"loose-{r}")
    container = F.concat_ws("-", "round", "part", "container")
    return reduce(DataFrame.unionByName, [*full, loose]).select("doc_id", "piece", "first_token", "n_tokens", container.alias("container_id"), "free_room")


def certificate(assigned: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers used, the lower bound over all items together, what is open between them, tokens and capacity."""
    histogram = _histogram(assigned, capacity)
    used = assigned.select("container_id").distinct().agg(F.count("*").alias("containers"))
    total, bound = int((histogram * np.arange(capacity + 1)).sum()), F.lit(lower_bound(histogram)).cast("bigint")
    return used.select("containers", bound.alias("lower_bound"), (F.col("containers") - bound).alias("open_gap"), F.lit(total).cast("bigint").alias("tokens"), F.lit(capacity).alias("capacity"))
