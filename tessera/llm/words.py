"""Words, shingles and their 64-bit hashes for batches of whole texts, in numpy.

A word is a run of bytes that are not ASCII white space, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RNG = np.random.RandomState(20_240_611)
_BYTE = _RNG.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Most bytes of text that are hashed at once; longer texts are taken alone.
BATCH_BYTES = 1 << 21
#: Longest array that a row is multiplied by.
CHUNK = 10_000
#: Most keys whose rows are kept out of a join's shuffle.
HEAVY = 4096


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class _Tables:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return _Tables, ()  # never sent: each worker makes its own

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(_BASE, n), powers(np.uint64(_inverse(int(_BASE))), n)
        return self.up, self.down


_TABLES = _Tables()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def batches(texts: Iterable[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 of about ``limit`` bytes at most, each with the number of its first text."""
    first, held, size, i = 0, [], 0, -1
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t is not None else b""
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _stripped(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at either edge; those of nothing else go. ``last`` is the old end."""
    last, start, end = end, start.copy(), end.copy()
    todo = np.arange(len(start))
    while len(todo := todo[(start[todo] < end[todo]) & _EDGE[raw[np.minimum(start[todo], len(raw) - 1)]]]):
        start[todo] += 1
    todo = np.arange(len(start))
    while len(todo := todo[(start[todo] < end[todo]) & _EDGE[raw[end[todo] - 1]]]):
        end[todo] -= 1
    some = start < end
    return start[some], end[some], last[some]


class Words:
    """The words of some texts: ``hash``, ``start`` and ``end`` (bytes) of each, and ``doc`` bounds."""

    def __init__(self, texts: list[bytes], lower: bool = True, strip: bool = False) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.raw = raw
        edge = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        #: The byte after each word's last one before stripping, for signs that end a sentence.
        if strip:
            self.start, self.end, self.last = _stripped(raw, self.start, self.end)
        up, down = _TABLES.get(len(raw) + 1)
        values = (_BYTE[_LOWER] if lower else _BYTE)[raw]
        values *= up[: len(raw)]
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values, out=sums[1:])
        self._sums, self._down = sums, down
        self.hash = self.hash_of(self.start, self.end)
        #: Byte where each text begins, and the number of its first word; one more entry closes the last.
        self.text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.first = np.searchsorted(self.start, self.text_at)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range; equal strings have equal hashes wherever they stand."""
        return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run over a text's end are to be left out."""
        return rolled(self.hash, k)


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring values, in order."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= _STEP
        out += values[i : i + n]
    return mix64(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles, lower-cased A-Z.

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    """
    w = Words(texts)
    every = w.shingles(k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix64(rolled(w.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def frames(rows: Iterator[pd.DataFrame], text: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Cuts frames into pieces with about ``limit`` bytes of text at most."""
    for frame in rows:
        for first, held in batches(frame[text], limit):
            yield frame.iloc[first : first + len(held)], held


def keyed_join(rows: DataFrame, keys: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows with keys (one row for each key; ``n`` says how many rows have it), safe against hot keys.

    Keys that hold over one HEAVY-th of all rows, so at most HEAVY of them, are broadcast, and their rows aren't shuffled.
    """
    every = keys.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    busy = F.col(n) > every // HEAVY + 1
    heavy = F.broadcast(keys.filter(busy))
    few = rows.join(heavy.select(key), key, "left_anti").join(keys.filter(~busy), key)
    return few.unionByName(rows.join(heavy, key))


def spread(rows: DataFrame, copies: str, number: str) -> DataFrame:
    """Each row ``copies`` times, with 0, 1, ... in ``number``; no array is longer than CHUNK, so hot rows stream through."""
    chunk = F.explode(F.expr(f"sequence(0L, greatest({copies} - 1, 0L) div {CHUNK})"))
    each = F.explode(F.expr(f"sequence(_chunk * {CHUNK}L, least({copies}, (_chunk + 1) * {CHUNK}L) - 1)"))
    return rows.filter(F.col(copies) > 0).withColumn("_chunk", chunk).withColumn(number, each).drop("_chunk")


def share(spark, value):
    """Broadcasts ``value`` once, by value, and returns a function that gives it on an executor."""
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), {}

    def get():
        if not held:
            held["value"] = pickle.loads(sent.value)
        return held["value"]

    get.sent = sent
    return get
