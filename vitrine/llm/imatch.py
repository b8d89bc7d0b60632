"""Document fingerprints by I-Match with randomised lexicon subsets.

Terms are runs of letters, of digits or of other marks, ASCII case folded. A text keeps the terms whose
inverse document frequency ``ln(N / df)`` lies in a band: neither the words of every text nor those of
hardly any, among them the torn words at a seam. Its distinct kept terms are sorted and hashed: once
over the whole lexicon, which is the classical fingerprint, and once for each of ``SLOTS`` random,
disjoint subsets of it, so that an edit spoils only the subsets that hold a changed term. Subsets are
thinned with the text: at level ``k`` they hold every 2^k-th term of the lexicon at random, and a text
uses the first level that leaves it at most ``TERMS`` terms, and the next one, so that texts whose levels
differ by one have subsets in common. The likeness of two fingerprints is 1 if their whole hashes are
equal, and else the share of subset hashes that they have in common (twice the equal ones over all).

Document frequencies are counted over the whole corpus in ``BUCKETS`` hashed counters, added per task
and then by Spark. What other terms add to a counter is, as a share of the texts, the mean number of rare
terms a text over ``BUCKETS`` however large the corpus is, far below the band's lower end. A text with more
than one in ``HEAVY`` of all rows counts once, so that its copies do not make its words common.

Defined results: null texts are empty; texts without a term (empty or blank) have the hash of no terms and
are alike; a text with fewer than ``FEW`` terms in the band uses all its terms, and is unlike every text that
does not; the next document of a row is the next larger id (nulls first, after the last the first), and of
rows that share an id the one whose text has the least hash; repeated rows are each returned; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import (BLANK, BYTE_CLASS, bounded_batches, chunks, flat, mix, prefix_hashes,
                                runs, substring_hashes)
from vitrine.operators.ranking import global_row_number

BUCKETS_LOG2 = 22
BUCKETS = 1 << BUCKETS_LOG2
BLOCK = 1 << 12            # counters that are sent as one row
MIN_IDF = 2.3              # terms in at most a tenth of the texts
MAX_IDF = 8.1              # and in at least three of ten thousand
HEAVY = 10_000
FEW = 4
SLOTS = 64
TERMS = 32
LEVELS = 27
CHUNK_BYTES = 1 << 20
WIDTH = 8 + 1 + 2 * SLOTS  # bytes: whole hash, lexicon and level, subset hashes of two levels

_FOLDED = np.arange(256)
_FOLDED[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every distinct term, sorted by document and hash."""
    starts, ends, classes = runs(BYTE_CLASS[data], offsets)
    word = classes != BLANK
    starts, ends = starts[word], ends[word]
    hashes = substring_hashes(prefix_hashes(_FOLDED[data]), starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int32)
    for _, data, offsets in chunks(batches, "text", CHUNK_BYTES):
        hashes, _ = terms(data, offsets)
        found, times = np.unique(_bucket(hashes), return_counts=True)
        counts[found] += times.astype(np.int32)
    for block, part in enumerate(counts.reshape(-1, BLOCK)):
        used = np.flatnonzero(part)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([used.astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([part[used].tobytes()], pa.binary())], names=["block", "at", "n"])


def _in_band(low: float, high: float):
    """Task: counters whose sum lies between; at most all of them are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(
                    n, np.int32)
        for block, total in sums.items():
            found = np.flatnonzero((total >= low) & (total <= high) & (total > 0)) + block * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["bucket"])
    return run


@dataclass(frozen=True)
class Lexicon:
    """The counters in the band, as bits."""

    bits: bytes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at, table = _bucket(hashes), np.frombuffer(self.bits, np.uint8)
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def fit_lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> Lexicon:
    """Terms of the band over all texts of ``docs(text)``."""
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    rows = docs.count()
    heavy = hashed.groupBy("h").agg(F.count("*").alias("n")).where(
        (F.col("n") > 1) & (F.col("n") * HEAVY > rows)).select("h")      # fewer than HEAVY rows
    once = hashed.join(F.broadcast(heavy), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    texts = hashed.join(F.broadcast(heavy), "h", "left_anti").select("text").unionByName(once.select("text"))
    copies = hashed.join(F.broadcast(heavy), "h", "left_semi").agg(
        F.count("*").alias("n"), F.count_distinct("h").alias("d")).first()
    n = rows - copies.n + copies.d
    found = texts.mapInArrow(_counted, "block int, at binary, n binary").repartition("block").mapInArrow(
        _in_band(n * math.exp(-max_idf), n * math.exp(-min_idf)), "bucket int").toArrow()
    table = np.zeros(BUCKETS, bool)                                        # at most BUCKETS rows
    table[found.column("bucket").to_numpy()] = True
    return Lexicon(np.packbits(table, bitorder="little").tobytes())


def _sequence_hashes(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash of the sorted terms of each group (both sorted); the groups that have terms."""
    if not len(groups):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(starts, len(groups)))
    rank = np.arange(len(groups)) - np.repeat(starts, sizes)
    placed = mix(hashes + (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return groups[starts], mix(np.add.reduceat(placed, starts))


def fingerprint_bytes(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` bytes per document."""
    docs = len(offsets) - 1
    hashes, doc = terms(data, offsets)
    band = lexicon.holds(hashes)
    few = np.bincount(doc[band], minlength=docs) < FEW
    used = band | few[doc]
    hashes, doc = hashes[used], doc[used]
    out = np.zeros((docs, WIDTH), np.uint8)
    at, whole = _sequence_hashes(doc, hashes)
    out[at, :8] = whole.astype(">u8").view(np.uint8).reshape(-1, 8)
    # the subsets: a level with halving probability and a slot, by other bits of the term's hash
    other = mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    slot = (other & np.uint64(SLOTS - 1)).astype(np.int64)
    rest = (other >> np.uint64(16)) | np.uint64(1 << (LEVELS - 1))
    level = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.int64)
    counts = np.bincount(doc * LEVELS + level, minlength=docs * LEVELS).reshape(docs, LEVELS)
    left = counts[:, ::-1].cumsum(1)[:, ::-1]                          # terms at a level or over it
    own = np.minimum((left > TERMS).sum(1), LEVELS - 2)
    out[:, 8] = own + 32 * few
    for more in (0, 1):
        there = level >= own[doc] + more
        group = doc[there] * SLOTS + slot[there]
        order = np.argsort(group, kind="stable")                       # terms stay sorted within
        at, small = _sequence_hashes(group[order], hashes[there][order])
        out[at // SLOTS, 9 + more * SLOTS + at % SLOTS] = small % np.uint64(255) + np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of the fingerprints in equal rows of two byte tables."""
    same = (a[:, :9] == b[:, :9]).all(1)
    low, high = np.minimum(a[:, 8] % 32, b[:, 8] % 32), np.maximum(a[:, 8] % 32, b[:, 8] % 32)

    def slots(x: np.ndarray) -> np.ndarray:
        return np.where((x[:, 8] % 32 == high)[:, None], x[:, 9:9 + SLOTS], x[:, 9 + SLOTS:])

    x, y = slots(a), slots(b)
    equal = ((x == y) & (x > 0)).sum(1)
    all_ = (x > 0).sum(1) + (y > 0).sum(1)
    comparable = (a[:, 8] // 32 == b[:, 8] // 32) & (high - low < 2) & (all_ > 0)
    return np.where(same, 1.0, np.where(comparable, 2 * equal / np.maximum(all_, 1), 0.0))


def _binary(table: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(WIDTH), len(table), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def fingerprint_documents(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """``print``, the fingerprint's bytes, of every row of ``docs``, beside the columns ``keep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in keep], _binary(fingerprint_bytes(lexicon, data, offsets))],
                names=[*keep, "print"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(
        run, ", ".join([*kinds, "print binary"]))


def _neighbours(docs: DataFrame) -> DataFrame:
    """``id, next_id, next_h, need``: the next document of every id and how many of its characters
    the longest row of the id takes."""
    ids = docs.groupBy("id").agg(F.max(F.char_length("text")).alias("n"), F.min(F.xxhash64("text")).alias("h"))
    numbered = global_row_number(ids, [F.col("id").asc_nulls_first()], "place")
    last = numbered.count()
    a, b = numbered.alias("a"), numbered.select(
        F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("place").alias("next_place"))
    return a.join(b, F.col("a.place") % F.lit(max(last, 1)) + 1 == F.col("next_place")).select(
        "a.id", "next_id", "next_h", F.expr("int(a.n div 4)").alias("need"))


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next one's are.

    The edited text has the last quarter of its characters replaced by the first as many of the
    next document. Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, the id under its own name. Texts are shuffled once: both joins read
    one exchange.
    """
    docs = bounded_batches(docs).select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lexicon = fit_lexicon(docs)
    # ids within a struct, which is never null: plain equality, and one partitioning for all that follows
    texts = docs.select(F.struct("id").alias("key"), "text")
    links = _neighbours(docs).select(F.struct("id").alias("key"), F.struct(F.col("next_id").alias("id")).alias(
        "next_key"), "next_h", "need")
    # not an equality of the hashes, which would become a join key and so another exchange
    is_next = F.xxhash64("s.text").bitwiseXOR(F.col("l.next_h")) == 0
    following = texts.alias("s").join(links.alias("l"), F.col("s.key") == F.col("l.next_key")).where(
        is_next).select("l.key", F.left("s.text", F.col("l.need")).alias("head"), "s.text")
    heads = fingerprint_documents(following, lexicon, "key", "head").groupBy("key").agg(
        F.min(F.struct("head", "print")).alias("next"))                             # repeated rows
    kept = F.expr("left(d.text, int(char_length(d.text) - char_length(d.text) div 4))")
    both = texts.alias("d").join(heads.alias("h"), F.col("d.key") == F.col("h.key")).select(
        "d.key.id", F.char_length("d.text").cast("bigint").alias("n_chars"), "d.text",
        F.concat(kept, F.expr("left(h.next.head, int(char_length(d.text) div 4))")).alias("edited"),
        F.col("h.next.print").alias("next_print")).withColumn(
        "edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "edited", CHUNK_BYTES):
            edited, following = fingerprint_bytes(lexicon, data, offsets), _bytes(rows.column("next_print"))
            data, offsets = flat(rows.column("text"))
            own = fingerprint_bytes(lexicon, data[offsets[0]:offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("n_chars"), rows.column("edited_sha256"),
                 *[pa.array([r.tobytes().hex() for r in table]) for table in (own, edited)],
                 pa.array(likeness(own, edited)), pa.array(likeness(own, following))],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next"])

    kind = docs.schema["id"].dataType.simpleString()
    return both.mapInArrow(
        run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_column)
