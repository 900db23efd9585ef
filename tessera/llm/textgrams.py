"""Word n-gram hashes of whole Arrow batches at once.

Texts come cleaned, with single blanks between words and none at the ends. All texts of a chunk
are one byte buffer; a prefix sum of a polynomial gives the hash of any run of bytes in constant
time, so hashing every n-gram of a batch takes a few array operations and no loop over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A chunk holds at most this many bytes of text, unless one text alone is longer.
CHUNK_BYTES = 1 << 20
_SEED = 20_240_607
_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.full(n, (_BASE if which == "up" else _UNBASE) % (1 << 64), np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(base)
        if n <= 4 * CHUNK_BYTES:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Chunk:
    """Words of a run of texts: ``first`` is the index of the first text, ``n`` their number."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.first, self.n, self.data, self.bounds = first, len(bounds) - 1, data, bounds
        blanks = np.flatnonzero(data == 32)
        begin, end = bounds[:-1], bounds[1:]
        full = end > begin
        self.starts = np.sort(np.concatenate([begin[full], blanks + 1]))
        self.ends = np.sort(np.concatenate([end[full], blanks]))
        self.doc = np.searchsorted(end, self.starts, side="right")
        self.words = np.bincount(self.doc, minlength=self.n)
        self.word_at = np.concatenate([[0], np.cumsum(self.words)])
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _power("up", max(1, len(data)))[: len(data)], out=sums[1:])
        self.sums = sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte runs [start, end)."""
        down = _power("down", len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every sequence of ``n`` words: its text in the chunk, the place of its first word, its hash."""
        last = len(self.starts) - n + 1
        if last <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        i = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        doc = self.doc[i]
        return doc, i - self.word_at[doc], self.hashes(self.starts[i], self.ends[i + n - 1])

    def text_hashes(self) -> np.ndarray:
        """One hash per text, of all its bytes."""
        return self.hashes(self.bounds[:-1], self.bounds[1:])


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """Cut a string array into chunks; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1)
        yield Chunk(whole[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to


def distinct_grams(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) without repeats, sorted by both."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]
