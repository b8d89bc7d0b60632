"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every word bucket has a fixed sparse ternary index vector; a
bucket's word vector is the sum of the index vectors of its neighbours within
``WINDOW`` words, counted over all documents. Words are runs of letters, digits
or other marks (digits count as one sign); they are hashed into ``BUCKETS``
buckets, so the model has a fixed size whatever the vocabulary. A document is
pooled to the mean and the spread of its unit word vectors, plus its length and
the shares of its words and word pairs that are distinct. A two-layer network (tanh, logistic) is
trained with numpy on a bounded sample of labelled rows; a temperature fitted on
training rows that the network has not seen calibrates its probabilities.

Defined results: null, empty or blank texts are pooled to zero vectors and get
the score of such a vector; rows with null or repeated ids are each scored;
without labelled rows, or with one class only, the score is that class's share
(0.5 without any); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import (BLANK, BYTE_CLASS, bounded_batches, chunks, prefix_hashes, runs,
                                segment_sums, substring_hashes)
from vitrine.llm.folds import bounded_ids, held_out

BUCKETS = 4096
DIMENSIONS = 32
NONZERO = 2
WINDOW = 2
MAX_LABELLED = 20000       # bound of the labelled sample
HIDDEN = 32
EPOCHS = 60
CHUNK_BYTES = 1 << 20
POOLED_DOCS = 64           # documents pooled at once
PAIR_BUCKETS = 1 << 13     # of neighbouring words
THRESHOLD = 0.3

_ONE_DIGIT = np.arange(256)
_ONE_DIGIT[48:58] = 48

_rng = np.random.Generator(np.random.PCG64(7))
_INDEX_AT = _rng.integers(0, DIMENSIONS, size=(NONZERO, BUCKETS))
_INDEX_SIGN = _rng.choice([-1.0, 1.0], size=(NONZERO, BUCKETS))


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and the number of words per document."""
    starts, ends, classes = runs(BYTE_CLASS[data], offsets)
    word = classes != BLANK
    starts, ends = starts[word], ends[word]
    hashes = substring_hashes(prefix_hashes(_ONE_DIGIT[data]), starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, counts


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's word vectors: neighbours' index vectors summed per bucket."""
    sums = np.zeros(BUCKETS * DIMENSIONS)
    for _, data, offsets in chunks(batches, "text", CHUNK_BYTES):
        bucket, counts = word_buckets(data, offsets)
        of_doc = np.repeat(np.arange(len(counts)), counts)
        for distance in range(1, WINDOW + 1):
            near = of_doc[distance:] == of_doc[:-distance] if distance < len(bucket) else []
            left, right = bucket[:-distance][near], bucket[distance:][near]
            for word, other in ((left, right), (right, left)):
                for at, sign in zip(_INDEX_AT, _INDEX_SIGN):
                    sums += np.bincount(word * DIMENSIONS + at[other], weights=sign[other],
                                        minlength=len(sums))
    sums = sums.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
    used = np.flatnonzero(sums.any(1))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), DIMENSIONS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), vectors.cast(pa.list_(pa.int64()))], names=["bucket", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (BUCKETS x DIMENSIONS) from the texts of all documents."""
    rows = (
        docs.select("text").mapInArrow(_context_sums, "bucket bigint, v array<bigint>")
        .groupBy("bucket").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIMENSIONS)])
        .toArrow())                                    # at most BUCKETS rows
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    if rows.num_rows:
        table[rows.column("bucket").to_numpy()] = np.column_stack(
            [rows.column(f"v{k}").to_numpy() for k in range(DIMENSIONS)])
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    return table


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One feature row per document.

    Documents are pooled a few at a time from their bucket counts: sums over words
    are then products with the word vectors.
    """
    bucket, counts = word_buckets(data, offsets)
    ends = np.cumsum(counts)
    squares, out = vectors * vectors, np.empty((len(counts), 2 * DIMENSIONS + 3), np.float32)
    for low in range(0, len(counts), POOLED_DOCS):
        size = counts[low:low + POOLED_DOCS]
        own = bucket[ends[low] - counts[low]:ends[low + len(size) - 1]]
        doc = np.repeat(np.arange(len(size)), size)
        times = np.bincount(doc * BUCKETS + own, minlength=len(size) * BUCKETS).reshape(-1, BUCKETS)
        n = np.maximum(size, 1)[:, None]
        weights = (times / n).astype(np.float32)
        mean = weights @ vectors
        spread = np.sqrt(np.maximum(weights @ squares - mean * mean, 0))
        inside = doc[1:] == doc[:-1]
        pair = (own[:-1] * 2654435761 + own[1:]) % PAIR_BUCKETS
        pairs = np.bincount((doc[:-1] * PAIR_BUCKETS + pair)[inside],
                            minlength=len(size) * PAIR_BUCKETS).reshape(-1, PAIR_BUCKETS)
        out[low:low + len(size)] = np.column_stack(
            [mean, spread, np.log1p(size), (times > 0).sum(1) / n[:, 0], (pairs > 0).sum(1) / n[:, 0]])
    return out


@dataclass(frozen=True)
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.center) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, hidden: int = HIDDEN,
                  epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam on the rows outside ``calibration``, then a temperature on those inside."""
    rng = np.random.default_rng(seed)
    fit = ~calibration
    if calibration.sum() < 20 or len(set(y[fit])) < 2:
        fit = np.ones(len(y), bool)
    center, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z, t = (x[fit] - center) / scale, y[fit].astype(np.float64)
    share = np.clip(t.mean(), 1e-3, 1 - 1e-3)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(share / (1 - share)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if 0 < t.mean() < 1 else 0):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            rows = order[at:at + 128]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2],
                     error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(center, scale, *p[:3], float(p[3]), 1.0)
    rows = calibration if calibration.any() else fit
    logits, target = net.logits(x[rows]), y[rows]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(target == 1, -1, 1) * logits / t_)) for t_ in grid]
    return Network(center, scale, *p[:3], float(p[3]), float(grid[int(np.argmin(loss))]))


def fit_quality(docs: DataFrame, labels: DataFrame, vectors: np.ndarray,
                max_labelled: int = MAX_LABELLED) -> Network | None:
    """Train on at most ``max_labelled`` labelled rows; None without any."""
    sample = bounded_ids(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
                         .groupBy("doc_id").agg(F.max("quality").alias("quality")),
                         max_labelled, "quality")
    dims = 2 * DIMENSIONS + 3

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            x = pa.FixedSizeListArray.from_arrays(pa.array(pooled(vectors, data, offsets).ravel()),
                                                  dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("quality"), rows.column("fold"), x], names=["y", "fold", "x"])

    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")           # bounded by max_labelled
        .select("text", F.col("quality").cast("int").alias("quality"),
                F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id").cast("string")), F.lit(5))
                .cast("int").alias("fold"))
        .mapInArrow(featurise, "y int, fold int, x array<float>").toArrow())
    if not found.num_rows:
        return None
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.float64)
    order = np.lexsort([*x.T[:4], found.column("y").to_numpy()])   # same rows in any task order
    y, fold = found.column("y").to_numpy()[order], found.column("fold").to_numpy()[order]
    return train_network(x[order], y, fold == 0)


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network | None) -> DataFrame:
    """``doc_id, score`` for every row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            p = net.probabilities(pooled(vectors, data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p)],
                                             names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if net is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0,
                     threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Learn from labels outside the held-out fold, score every row.

    Returns ``doc_id, held_out, score, predicted``.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    vectors = word_vectors(bounded_batches(docs))
    net = fit_quality(docs, labels.where(~out).select("doc_id", "quality"), vectors, max_labelled)
    return score_quality(docs, vectors, net).select(
        "doc_id", out.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
