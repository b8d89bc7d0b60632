"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any text of the training fold is
unlabelled. Linear classifiers over the presence of words and word beginnings are trained with numpy
on the class-prior-corrected risk

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1)),

whose second term, an estimate of the risk on clean text, is kept from going
negative (steps that would fit it below zero are reversed). Words are runs of
letters with ASCII case folded, hashed into ``BUCKETS`` buckets; the features are
the ``FEATURES`` buckets whose document frequencies differ most between toxic and
unlabelled text.

Only the toxic texts are a bounded sample (of ``MAX_POSITIVE`` labelled rows). Document
frequencies, class prior and unlabelled risk cover every document of the training fold:
documents become patterns of features, equal patterns are counted, and the patterns are
dealt to shards of about ``SHARD_DOCUMENTS`` documents, a pattern's documents evenly over
all of them. Each shard trains on its documents against the same toxic texts, and a
classifier is the mean of the shards' weights (parameter mixing). Every text is scored
whole, and the score is the mean of the classifiers' probabilities.

Defined results: null and empty texts have no word and get the classifiers' base
score; rows with null ids are scored, not learned from; rows that repeat an id are each
scored and learned from; without a positive row every score is 0; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import (BYTE_CLASS, LETTER, bounded_batches, chunks, prefix_hashes, runs,
                                segment_sums, substring_hashes)
from vitrine.llm.folds import bounded_ids, held_out
from vitrine.operators.materialize import discard, materialize

BUCKETS = 1 << 20
STEMS = (4, 5)             # bytes of the word beginnings that are features beside the words
FEATURES = 512
STRONGEST = 16             # features that the class prior is estimated from
MIN_DOCUMENTS = 5          # documents that a feature occurs in, toxic ones counted twice
MAX_POSITIVE = 8000        # bound of the sample of texts labelled toxic
SHARD_DOCUMENTS = 16000    # unlabelled documents that one task trains on
CLASSIFIERS = 3
STEPS = 300
CHUNK_BYTES = 2 << 20
THRESHOLD = 0.7
_GRID = 1e12               # weights are added as whole numbers, in any order alike

_FOLDED = np.arange(256)
_FOLDED[65:91] += 32


def _word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and of the stems of longer words."""
    starts, ends, classes = runs(BYTE_CLASS[data], offsets)
    letters = classes == LETTER
    starts, ends = starts[letters], ends[letters]
    prefix = prefix_hashes(_FOLDED[data])
    counts = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(len(counts)), counts)
    hashes, docs = [substring_hashes(prefix, starts, ends)], [doc]
    for size in STEMS:
        longer = ends - starts > size
        hashes.append(substring_hashes(prefix, starts[longer], starts[longer] + size) * np.uint64(size))
        docs.append(doc[longer])
    return (np.concatenate(hashes) >> np.uint64(20)).astype(np.int64) % BUCKETS, np.concatenate(docs)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket, toxic and all, of the task's rows; bucket -1 has those of any text."""
    total = np.zeros((2, BUCKETS + 1), np.int64)
    for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
        bucket, doc = _word_buckets(data, offsets)
        pairs = np.unique(doc * BUCKETS + bucket)
        positive = rows.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        bucket = pairs % BUCKETS
        total[0, :-1] += np.bincount(bucket[positive[pairs // BUCKETS]], minlength=BUCKETS)
        total[1, :-1] += np.bincount(bucket, minlength=BUCKETS)
        total[:, -1] += positive.sum(), len(positive)
    used = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.where(used < BUCKETS, used, -1)), *map(pa.array, total[:, used])],
        names=["bucket", "n_pos", "n_all"])


@dataclass(frozen=True)
class ToxicModel:
    feature: np.ndarray     # bucket -> feature, or -1
    weights: np.ndarray     # (classifier, feature)
    bias: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pairs = present(self.feature, data, offsets, self.weights.shape[1])
        counts = np.bincount(pairs // self.weights.shape[1], minlength=len(offsets) - 1)
        logits = segment_sums(self.weights.T[pairs % self.weights.shape[1]], counts) + self.bias
        return (1 / (1 + np.exp(-np.clip(logits, -60, 60)))).mean(1)


def present(feature: np.ndarray, data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Sorted ``document * n + feature`` of the features that occur."""
    bucket, doc = _word_buckets(data, offsets)
    found = feature[bucket]
    return np.unique(doc[found >= 0] * n + found[found >= 0])


def train_pu(x: np.ndarray, positive: np.ndarray, prior: float, seed: int,
             steps: int = STEPS, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of one logistic classifier on the non-negative PU risk.

    Each classifier sees a bootstrap of either sample; steps use all of it, since
    the sign of the clean risk is lost in the noise of small batches.
    """
    rng = np.random.default_rng(seed)
    at_pos, at_unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    pos = x[rng.choice(at_pos, len(at_pos))]
    unl = x[rng.choice(at_unl, (len(at_unl) + 1) // 2)]
    p = np.append(np.zeros(x.shape[1]), np.log(prior / (1 - prior))).astype(np.float32)
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigma = lambda g: 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    for step in range(1, steps + 1):
        gp, gu = pos @ p[:-1] + p[-1], unl @ p[:-1] + p[-1]
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # derivatives of the losses with respect to the outputs
        wrong_pos = -prior * (1 - sigma(gp)) / len(gp)
        clean_unl, clean_pos = sigma(gu) / len(gu), -prior * sigma(gp) / len(gp)
        if clean >= 0:
            dp, du = wrong_pos + clean_pos, clean_unl
        else:                                # step back from a negative risk
            dp, du = -clean_pos, -clean_unl
        g = np.append(pos.T @ dp + unl.T @ du + decay * p[:-1], dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = (p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
             ).astype(np.float32)
    return p[:-1].astype(np.float64), float(p[-1])


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE) -> DataFrame:
    """``text, positive`` of all documents with an id; toxic ones are of at most ``max_positive`` ids."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = bounded_ids(labelled.where("toxic = 1").select("doc_id"), max_positive, "positive")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(
        F.broadcast(toxic.withColumn("positive", F.lit(True))), "doc_id", "left").select(
        "text", F.coalesce("positive", F.lit(False)).alias("positive"))


def choose_features(rows: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, float, int]:
    """Buckets of the features, strongest first, the class prior, and the number of documents.

    A word that only toxic texts use occurs in unlabelled text at the prior times its
    rate in toxic text, so the prior is the median of that ratio over the strongest toxic
    features. The counts that reach the driver are one row per bucket, whatever the input.
    """
    counted = (rows.mapInArrow(_document_frequencies, "bucket bigint, n_pos bigint, n_all bigint")
               .groupBy("bucket").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_all").alias("n_all"))
               .toArrow())
    bucket, pos, every = (counted.column(c).to_numpy() for c in ("bucket", "n_pos", "n_all"))
    order = np.argsort(bucket)
    bucket, pos, every = bucket[order], pos[order], every[order]
    if not len(bucket) or not pos[0]:
        return np.zeros(0, np.int64), 0.5, int(every[0]) if len(every) else 0
    n_pos, n_all = float(pos[0]), float(every[0])       # bucket -1 comes first
    a, b, both = pos[1:] / n_pos, every[1:] / n_all, pos[1:] + every[1:]
    pooled = both / (n_pos + n_all)
    z = np.abs(a - b) / np.sqrt(pooled * (1.0001 - pooled) * (1 / n_pos + 1 / n_all))
    use = np.flatnonzero((both >= MIN_DOCUMENTS) & (z > 4))
    use = use[np.argsort(-z[use], kind="stable")][:features]
    ratios = (b[use] / np.maximum(a[use], 1e-9))[a[use] > b[use]][:STRONGEST]
    prior = float(np.clip(np.median(ratios) if len(ratios) else 0.5, 0.001, 0.9))
    return bucket[1:][use], prior, int(n_all)


def _unpacked(patterns: list[bytes], times: np.ndarray, n: int) -> np.ndarray:
    """One row of features per document, in the order of the patterns' bytes."""
    order = np.argsort(np.array(patterns, dtype=object), kind="stable")
    bits = np.frombuffer(b"".join(patterns[k] for k in order), np.uint8).reshape(len(patterns), -1)
    x = np.unpackbits(bits, axis=1)[:, :n].astype(np.float32)
    return np.repeat(x, times[order], axis=0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None,
                 max_positive: int = MAX_POSITIVE, features: int = FEATURES,
                 classifiers: int = CLASSIFIERS, shard_documents: int = SHARD_DOCUMENTS
                 ) -> ToxicModel | None:
    """Train on documents and labels of the training fold; None without a toxic row.

    Without a given class prior it is estimated (see ``choose_features``).
    """
    rows = training_rows(docs, labels, max_positive)
    buckets, estimate, documents = choose_features(rows, features)
    if not len(buckets):
        return None
    prior = estimate if prior is None else prior
    n = len(buckets)
    feature = np.full(BUCKETS, -1, np.int32)
    feature[buckets] = np.arange(n)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            x = np.zeros((rows_.num_rows, n), bool)
            x.reshape(-1)[present(feature, data, offsets, n)] = True
            packed = np.packbits(x, axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows_.column("positive"), pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["positive", "x"])

    # one row per pattern and shard; c documents with one pattern are dealt evenly to the shards
    shards = max(1, round(documents / shard_documents))
    patterns = rows.mapInArrow(featurise, "positive boolean, x binary").groupBy("x").agg(
        F.count("*").alias("c"), F.count_if("positive").alias("n_pos"))
    patterns = materialize(patterns, "toxicity-patterns")
    try:
        toxic = patterns.where("n_pos > 0").select("x", "n_pos").orderBy(
            F.xxhash64("x"), "x").limit(max_positive).toArrow()
        known, often = toxic.column("x").to_pylist(), np.diff(
            np.minimum(np.cumsum(toxic.column("n_pos").to_numpy()), max_positive), prepend=0)
        dealt = patterns.select("x", "c", F.explode(
            F.sequence(F.lit(0), F.least("c", F.lit(shards)).cast("int") - 1)).alias("k")).select(
            F.pmod(F.xxhash64("x") + F.col("k"), F.lit(shards)).cast("int").alias("shard"), "x",
            (F.floor(F.col("c") / shards) + (F.col("k") < F.col("c") % shards).cast("int"))
            .cast("long").alias("times")).repartition(shards, "shard")   # patterns are small, training is not

        def train(shard: pa.Table) -> pa.Table:
            x = np.vstack([_unpacked(known, often, n),
                           _unpacked(shard.column("x").to_pylist(), shard.column("times").to_numpy(), n)])
            positive = np.arange(len(x)) < often.sum()
            number = shard.column("shard")[0].as_py()
            trained = [train_pu(x, positive, prior, number * classifiers + k) for k in range(classifiers)]
            values = np.array([[*w, b] for w, b in trained])
            return pa.table({"shard": pa.array(np.full(values.size, number, np.int32)),
                             "at": pa.array(np.arange(values.size)), "value": pa.array(values.reshape(-1))})

        # rounded to a grid, so that the sums do not depend on their order
        total = (dealt.groupBy("shard").applyInArrow(train, "shard int, at bigint, value double")
                 .groupBy("at").agg(F.sum(F.round(F.col("value") * _GRID).cast("decimal(38,0)")).alias("s"),
                                    F.count("*").alias("m"))
                 .orderBy("at").select((F.col("s").cast("double") / F.col("m") / _GRID).alias("value"))
                 .toArrow())
    finally:
        discard(patterns)
    values = total.column("value").to_numpy().reshape(classifiers, n + 1)
    return ToxicModel(feature, values[:, :-1], values[:, -1])


def score_toxicity(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """``doc_id, score`` for every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(model.scores(data, offsets))],
                names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1,
                      threshold: float = THRESHOLD, **fit) -> DataFrame:
    """Learn from the rows outside the held-out fold, score every row.

    Returns ``doc_id, held_out, score, predicted``.
    """
    out = held_out(F.col("doc_id"), folds, fold)
    model = fit_toxicity(bounded_batches(docs).where(~out), labels.where(~out).select("doc_id", "toxic"), **fit)
    return score_toxicity(docs, model).select(
        "doc_id", out.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
