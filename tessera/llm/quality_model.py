"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token bucket has a fixed sparse random index vector; a bucket's word vector is the sum of the
index vectors of its neighbours in the fitted texts. Tokens are words without outer punctuation,
their punctuation, and their shape. A document's vectors are averaged and joined with ratios of its
text; a network with one hidden layer scores them, and a temperature fitted on rows that the network
has not seen makes the scores probabilities.

Fitted on a bounded sample (MAX_FIT rows of each label, by hashed id); scoring reads whole texts.

Defined results: null and empty texts get a score like any other; labels that are null are left out,
of several labels for an id the largest counts; without rows of both labels every score is the
smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import _EDGE, Words, batches, frames, share
from tessera.session import cut

#: Most rows of each label that a model is fitted on.
MAX_FIT = 4_000
BUCKETS_LOG2, DIM, NONZERO, REACH = 14, 32, 6, 2
BUCKETS = 1 << BUCKETS_LOG2
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.01, 1e-3
THRESHOLD = 0.3
PARTS = 8
BATCH = 1 << 19


def index_vectors() -> np.ndarray:
    """The fixed ternary vectors of all buckets."""
    rng = np.random.RandomState(11)
    out = np.zeros((BUCKETS, DIM), dtype=np.int8)
    at = np.argsort(rng.rand(BUCKETS, DIM), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def _class_table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.int64)
    t[list(chars.encode())] = 1
    return t


_SYMBOL, _UPPER = _class_table("#*$%&|<>"), _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NUM, _LINE = _class_table("0123456789"), _class_table("\n")
_PUNCT = _EDGE.astype(np.int64)
_TABLES = (_SYMBOL, _UPPER, _NUM, _PUNCT, _LINE)
RATIOS = 15


class Tokens:
    """Token buckets of some texts in order, with the bounds of each text, and ratios of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        w = Words(texts)
        raw, n = w.raw, len(w.start)
        start, end = w.start.copy(), w.end.copy()
        todo = np.arange(n)
        while len(todo := todo[(start[todo] < end[todo]) & _EDGE[raw[start[todo]]]]):
            start[todo] += 1
        todo = np.arange(n)
        while len(todo := todo[(start[todo] < end[todo]) & _EDGE[raw[end[todo] - 1]]]):
            end[todo] -= 1
        shift = np.uint64(64 - BUCKETS_LOG2)
        core = (w.hash_of(start, end) >> shift).astype(np.int64)
        tail = (w.hash_of(end, w.end) >> shift).astype(np.int64)
        upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
        capitals = upper[end] - upper[start]
        shape = np.where(capitals == 0, -1, np.where(capitals == 1, 1, np.where(2 * capitals > end - start, 2, 3)))
        stream = np.stack([np.where(start < end, core, -1), np.where(end < w.end, tail, -1), shape], axis=1)
        keep = stream >= 0
        self.bucket = stream[keep]
        per_word = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
        self.first = per_word[w.first]
        self.ratios = self._ratios(w, texts)

    @staticmethod
    def _ratios(w: Words, texts: list[bytes]) -> np.ndarray:
        n = np.diff(w.first).astype(np.float64)
        some = np.maximum(n, 1)
        size = np.maximum(np.array([len(t) for t in texts], dtype=np.float64), 1)
        cols = [np.log1p(n), size / some, np.log1p(size)]
        for table in _TABLES:
            sums = np.concatenate(([0], np.cumsum(table[w.raw])))
            cols.append((sums[w.text_at[1:] - 1] - sums[w.text_at[:-1]]) / size)
        text_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
        for step in (1, 2, 3, 4):
            same = (w.hash[step:] == w.hash[:-step]) & (text_of[step:] == text_of[:-step])
            cols.append(np.bincount(text_of[step:][same], minlength=len(texts)) / some)
        distinct, trigrams, lines = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        three = w.shingles(3)
        for i, t in enumerate(texts):
            a, b = w.first[i], w.first[i + 1]
            distinct[i] = len(np.unique(w.hash[a:b])) / max(b - a, 1)
            trigrams[i] = 1 - len(np.unique(three[a : max(a, b - 2)])) / max(b - a - 2, 1) if b - a > 2 else 0
            parts = [x for x in t.split(b"\n") if x]
            lines[i] = 1 - len(set(parts)) / max(len(parts), 1)
        return np.stack([*cols, distinct, trigrams, lines], axis=1)


def neighbour_sums(buckets: np.ndarray, text_of: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the index vectors of each token's neighbours within REACH in its text."""
    for step in range(1, REACH + 1):
        same = text_of[step:] == text_of[:-step]
        a, b = buckets[:-step][same], buckets[step:][same]
        for left, right in ((a, b), (b, a)):
            pairs, count = np.unique(left * BUCKETS + right, return_counts=True)
            rows = pairs // BUCKETS
            if len(rows):
                at = np.flatnonzero(np.diff(rows, prepend=-1))
                out[rows[at]] += np.add.reduceat(index[pairs % BUCKETS].astype(np.int64) * count[:, None], at, axis=0)


def _partial_tables(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index, out = index_vectors(), np.zeros((BUCKETS, DIM), dtype=np.int64)
    for _, held in frames(rows, "text", BATCH):
        t = Tokens(held)
        neighbour_sums(t.bucket, np.repeat(np.arange(len(held)), np.diff(t.first)), index, out)
    yield pd.DataFrame({"part": [out.astype(np.int32).tobytes()]})


@dataclass
class Model:
    """Word vectors (BUCKETS, DIM), scaling of the features, network and temperature."""

    vectors: np.ndarray
    prior: float
    scale: tuple | None = None
    net: tuple | None = None
    temperature: float = 1.0

    def features(self, texts: list[bytes]) -> np.ndarray:
        t = Tokens(texts)
        v = self.vectors[t.bucket]
        sums = np.zeros((len(texts), DIM))
        full = np.flatnonzero(np.diff(t.first) > 0)
        if len(full):
            sums[full] = np.add.reduceat(v, t.first[full], axis=0)
        mean = sums / np.maximum(np.diff(t.first), 1)[:, None]
        return np.concatenate([mean, t.ratios], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mid, spread = self.scale
        w1, b1, w2, b2 = self.net
        return np.tanh(np.clip((x - mid) / spread, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> tuple:
    """Weights of a tanh layer and a logistic unit, by Adam on weighted cross-entropy."""
    rng = np.random.RandomState(seed)
    p = [rng.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        h = np.tanh(x @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) * weight
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [x.T @ back + DECAY * p[0] / len(p[1]), back.sum(axis=0), h.T @ error + DECAY * p[2] / len(p[1]), error.sum()]
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted cross-entropy."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [(weight * np.logaddexp(0, np.where(y == 1, -logits, logits) / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = MAX_FIT) -> Model:
    """Fits on at most ``max_fit`` rows of each label; ``labels`` holds those that may be learnt from."""
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    # Labels of documents that aren't there would use up the sample.
    known = cut(known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(np.zeros((BUCKETS, DIM), dtype=np.float32), prior)
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_fit) for y in (0, 1)]
    # At most 2 * max_fit short rows are broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    # Of rows with one id the text with the least hash is learnt from, so that reruns agree.
    texts = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = cut(texts.repartition(PARTS, "id"))
    parts = sample.select("text").coalesce(PARTS).mapInPandas(_partial_tables, "part binary").collect()
    total = sum(np.frombuffer(r["part"], dtype=np.int32).reshape(BUCKETS, DIM).astype(np.float64) for r in parts)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    model = Model((total / np.maximum(norm, 1e-9)).astype(np.float32), prior)

    def featured(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, held in frames(rows, "text", BATCH):
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "y": frame["y"].to_numpy(), "x": list(model.features(held))})

    got = sample.mapInPandas(featured, "id long, y int, x array<double>").orderBy("id").toPandas()
    if got["y"].nunique() < 2:
        return model
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(np.float64)
    weight = np.where(y == 1, n1 / max((y == 1).sum(), 1), n0 / max((y == 0).sum(), 1))
    apart = (np.arange(len(y)) * 2654435761 % 1000) < 200
    if not 0 < y[apart].sum() < apart.sum() or not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    model.scale = (x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6)
    scaled = np.clip((x - model.scale[0]) / model.scale[1], -8, 8)
    model.net = train_network(scaled[~apart], y[~apart], weight[~apart])
    if apart.any():
        model.temperature = fit_temperature(model.logits(x[apart]), y[apart], weight[apart])
    return model


def score(model: Model, text: Column, spark) -> Column:
    """The probability of label 1 of each text."""
    shared = share(spark, model)  # BUCKETS * DIM floats and a small network

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        parts = [shared().scores(held) for _, held in batches(texts, BATCH)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, held_out (no label of it was learnt from), score and predicted."""
    model = fit(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(model, F.col(text_col), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
