"""Repetition inside a document: a calibrated classifier over hashed n-grams with two fixed thresholds.

Per document, word and character n-grams are hashed into a table of its own and each family is reduced
to its excess share: the part of its n-grams whose slot an earlier one has filled. A logistic
regression over these shares is trained on labelled rows and calibrated. Documents are scored in Arrow
batches: those of a probability below REJECT_BELOW are left out, those of ACCEPT_ABOVE or more are taken,
and only the band between is decided by the exact count, in the same pass over the texts.

Weights can't be negative and hashed shares are never below the exact ones, so a document that meets
the definition has at least the probability of one with just the defining share and zeros elsewhere; the
calibration keeps that probability at REJECT_BELOW or above, so none is lost. In the same way it keeps
the probability of a document just below the defining share with 1 in all other families below ACCEPT_ABOVE.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import pick
from tessera.llm import textgrams as G
from tessera.llm.leakage import plain_words
from tessera.shipping import ship_package

WORD_SIZES = (1, 2, 3, 4, 6)
CHAR_SIZES = (12, 40)
FEATURES = [f"word_{n}" for n in WORD_SIZES] + [f"char_{n}" for n in CHAR_SIZES]
#: The family the definition speaks of, and how much less than the others its weight is held down.
DEFINING, LIGHT, HEAVY = FEATURES.index("word_4"), 1e-6, 1e-2
#: Labelled rows the classifier is fitted on, at most.
MAX_LABELLED = 5_000
#: Fixed thresholds: documents below the first are left out, from the second on taken, between them counted.
REJECT_BELOW, ACCEPT_ABOVE = 0.02, 0.98
#: What collisions of hashed n-grams may add to a share before it counts as certain.
COLLISIONS = 0.1
#: Slots of a document's table per n-gram, and at least.
SLOTS, LEAST_SLOTS = 32, 4_096

_table = np.zeros(0, np.int32)


def _hashed_excess(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n-grams in all, and those that fall in a slot of the text's own table that another one holds.

    The table is never cleared: an n-gram holds its slot if its number is still there after all were written."""
    global _table
    total = np.bincount(doc, minlength=n_docs)
    room = np.int64(1) << np.ceil(np.log2(np.maximum(total * SLOTS, LEAST_SLOTS))).astype(np.int64)
    room[total == 0] = 0
    begin = np.cumsum(room) - room
    if len(_table) < room.sum():
        _table = np.zeros(int(room.sum()), np.int32)
    slot = begin[doc] + (h & (room[doc] - 1).astype(np.uint64)).astype(np.int64)
    number = np.arange(len(h), dtype=np.int32)
    _table[slot] = number
    return total, total - np.bincount(doc[_table[slot] == number], minlength=n_docs)


def _char_grams(c: G.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n bytes of the cleaned text that begin with a word."""
    ends = c.bounds[1:][c.doc]
    i = np.flatnonzero(c.starts + n <= ends)
    return c.doc[i], c.hashes(c.starts[i], c.starts[i] + n)


def hashed_shares(c: G.Chunk) -> np.ndarray:
    """One row per text: the excess share of each family in FEATURES; 0 where a text has no such n-gram."""
    shares = []
    for doc, h in [*[c.grams(n)[::2] for n in WORD_SIZES], *[_char_grams(c, n) for n in CHAR_SIZES]]:
        total, again = _hashed_excess(doc, h, c.n)
        shares.append(again / np.maximum(total, 1))
    return np.stack(shares, 1)


def four_gram_counts(c: G.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text, exactly up to 64-bit hashes: word four-grams, and those that repeat an earlier one; of the texts ``wanted`` only."""
    doc, _, h = c.grams(4)
    if wanted is not None:
        mine = wanted[doc]
        doc, h = doc[mine], h[mine]
    total = np.bincount(doc, minlength=c.n)
    return total, total - np.bincount(G.distinct_grams(doc, h)[0], minlength=c.n)


def _words(documents: DataFrame) -> DataFrame:
    return pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_words(F.col("text")).alias("words"))


_COUNTED = "doc_id bigint, n_words bigint, n_grams bigint, n_repeated bigint"


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_grams, n_repeated) of every document: its word four-grams and those that repeat an earlier one.

    One Arrow pass over whole texts; null texts count as empty, repeated rows come out repeatedly."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in G.chunks(batch.column(1)):
                counts = [pa.array(x.astype(np.int64)) for x in (c.words, *four_gram_counts(c))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), *counts], ["doc_id", "n_words", "n_grams", "n_repeated"])

    ship_package(documents.sparkSession)
    return _words(documents).mapInArrow(emit, _COUNTED)


@dataclass(frozen=True)
class RepetitionModel:
    """Weights per family (none negative), bias, and the calibration p = 1 / (1 + exp(-(scale z + shift))) with scale > 0."""

    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -500, 500)))

    def bounds(self, share: float) -> tuple[float, float]:
        """Least probability of a document of at least the defining ``share``, and the most of one below it."""
        x = np.zeros((2, len(FEATURES)))
        x[1] = 1.0
        x[:, DEFINING] = share, share + COLLISIONS
        low, high = self.probability(x)
        return float(low), float(high)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 200) -> RepetitionModel:
    """Projected Newton steps on even rows, Platt calibration within the bounds on odd rows.

    With one class only, or too few rows, the model is undecided: probability 0.5 for all."""
    train, held = np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1
    if len(y) < 4 or min(y[train].min(), y[held].min()) == 1 or max(y[train].max(), y[held].max()) == 0 or y[train].min() == y[train].max():
        return RepetitionModel()
    a, t, n = np.c_[x[train], np.ones(train.sum())], y[train], train.sum()
    ridge = np.full(a.shape[1], HEAVY)
    ridge[DEFINING], ridge[-1] = LIGHT, 0.0
    loss = lambda v: np.logaddexp(0, np.where(t > 0, -1, 1) * (a @ v)).mean() + (ridge * v * v).sum() / 2
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        slope = a.T @ (p - t) / n + ridge * w
        free = np.r_[(w[:-1] > 0) | (slope[:-1] < 0), True]
        curve = (a[:, free] * (p * (1 - p))[:, None]).T @ a[:, free] / n + np.diag(ridge[free] + 1e-9)
        step, size = np.zeros_like(w), 1.0
        step[free] = np.linalg.solve(curve, slope[free])
        now = loss(w)
        while size > 1e-6:
            new = w - size * step
            new[:-1] = np.maximum(0.0, new[:-1])
            if loss(new) < now - 1e-12:
                break
            size /= 2
        else:
            break
        w = new
    z, t = x[held] @ w[:-1] + w[-1], y[held]
    soft = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    unit = max(1.0, float(np.sqrt((z * z).mean())))
    scale, shift = 1.0, 0.0
    for _ in range(500):
        gap = _sigmoid(scale * z + shift) - soft
        scale, shift = max(1e-3, scale - 0.5 * (gap * z).mean() / unit**2), shift - 0.5 * gap.mean()
    logit = lambda p: float(np.log(p / (1 - p)))
    least = w[DEFINING] * share + w[-1]
    most = w[DEFINING] * (share + COLLISIONS) + w[:-1].sum() - w[DEFINING] + w[-1]
    scale = min(scale, 0.999 * (logit(ACCEPT_ABOVE) - logit(REJECT_BELOW)) / max(most - least, 1e-9))
    shift = min(max(shift, logit(REJECT_BELOW * 1.0001) - scale * least), logit(ACCEPT_ABOVE * 0.9999) - scale * most)
    return RepetitionModel(tuple(w[:-1].tolist()), float(w[-1]), float(scale), float(shift))


def labelled(documents: DataFrame, share_tenths: int = 3, min_words: int = 20, bound: int = MAX_LABELLED) -> pd.DataFrame:
    """(features, label) of at most ``bound`` documents of at least ``min_words`` words, chosen by a hash of the id, the same on every run.

    The tables hold no quality labels, so the label is the definition itself. As the choice is random, the
    share of labels is that of the corpus, and so are the calibrated probabilities."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in G.chunks(batch.column(1)):
                total, again = four_gram_counts(c)
                rows = np.flatnonzero(c.words >= min_words)
                flat = hashed_shares(c)[rows].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), pa.array(flat))
                label = (10 * again >= share_tenths * total)[rows].astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + c.first)), lists, pa.array(label)], ["doc_id", "features", "label"])

    n = max(1, documents.count())
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 32)) < int(min(1.0, 0.9 * bound / n) * (1 << 32))
    ship_package(documents.sparkSession)
    chosen = _words(pick(documents, "doc_id", "text").filter(part)).mapInArrow(emit, "doc_id bigint, features array<double>, label double")
    return chosen.limit(bound).toPandas().sort_values("doc_id", kind="stable")


def train(documents: DataFrame, share_tenths: int = 3, min_words: int = 20, bound: int = MAX_LABELLED) -> RepetitionModel:
    rows = labelled(documents, share_tenths, min_words, bound)
    if not len(rows):
        return RepetitionModel()
    return fit(np.array(rows["features"].tolist()), rows["label"].to_numpy(), share_tenths / 10)


def scored(documents: DataFrame, model: RepetitionModel, min_words: int = 20, reject_below: float = REJECT_BELOW) -> DataFrame:
    """(doc_id, n_words, n_grams, n_repeated, probability) of the documents of at least ``min_words`` words whose
    probability is ``reject_below`` or more. Four-grams are counted for these only."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in G.chunks(batch.column(1)):
                p = model.probability(hashed_shares(c))
                wanted = (c.words >= min_words) & (p >= reject_below)
                rows = np.flatnonzero(wanted)
                counts = [pa.array(v[rows].astype(np.int64)) for v in (c.words, *four_gram_counts(c, wanted))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + c.first)), *counts, pa.array(p[rows])], ["doc_id", "n_words", "n_grams", "n_repeated", "probability"])

    ship_package(documents.sparkSession)
    return _words(documents).mapInArrow(emit, f"{_COUNTED}, probability double")


def repeated_share() -> Column:
    return F.when(F.col("n_grams") > 0, F.col("n_repeated") / F.col("n_grams")).otherwise(F.lit(0.0))


def repetitive(documents: DataFrame, share_tenths: int = 3, min_words: int = 20) -> DataFrame:
    """(doc_id, repeated_share, probability, decided_by) of documents of at least ``min_words`` words in which at
    least ``share_tenths`` tenths of the four-word sequences are repetitions.

    ``decided_by`` is ``model`` from ACCEPT_ABOVE on and else ``count``. Texts shorter than that, empty and
    null texts never qualify; documents without an id take no part. Repeated doc_ids give repeated rows.
    """
    documents = pick(documents, "doc_id", "text").filter("doc_id is not null")
    found = scored(documents, train(documents, share_tenths, min_words), min_words)
    sure = F.col("probability") >= ACCEPT_ABOVE
    kept = found.filter(sure | (10 * F.col("n_repeated") >= share_tenths * F.col("n_grams")))
    return kept.select("doc_id", repeated_share().alias("repeated_share"), "probability", F.when(sure, "model").otherwise("count").alias("decided_by"))
