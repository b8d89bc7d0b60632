"""N-gram Jaccard self-join of documents by MinHash banding.

A document is the set of its ``n``-word shingles (one shingle of all its words if
it has fewer; words are runs of characters other than ASCII white space). Equal
sets form a class of copies, of which only the smallest id goes on. The number of
bands and of rows per band follows from the threshold and the recall asked at it.
Classes that share a band hash are candidates; candidates are verified on their
full shingle sets. Classes reached from each other through candidates are verified
together, all against all, in blocks of bounded size: a large group is dealt by a
hash into blocks, every pair of blocks is one task's group, and it returns each
document's number of links and its label, not its pairs.

Ids are integers. Defined results: null, empty and blank texts have no shingle
and no link and are a class of their own; rows with a null id are left out;
repeated rows of one id and text count once, different texts under one id are
linked like other documents and give one row each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import bounded_batches, chunks, gram_hashes, mix, word_hashes
from vitrine.llm.components import connected_components
from vitrine.llm.folds import free_prefix, positional
from vitrine.operators.materialize import discard, materialize
from vitrine.operators.ranking import global_row_number

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 96
BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 2 << 20
_COLUMNS = 2048


def choose_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES
                 ) -> tuple[int, int]:
    """(bands, rows): the most rows, so fewest false candidates, that reach the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = next((b for b in range(1, max_hashes // rows + 1)
                      if 1 - (1 - threshold ** rows) ** b >= recall), None)
        if bands is not None:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within max_hashes reaches the recall")
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, one after the other, and how many each has."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    grams = gram_hashes(words, n)
    amount = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    out_ends = np.cumsum(amount)
    out = np.empty(int(out_ends[-1]) if len(out_ends) else 0, np.uint64)
    long_ = np.flatnonzero(counts >= n)
    if len(long_):
        size = amount[long_]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(out_ends[long_] - size, size) + inner] = grams[
            np.repeat(ends[long_] - counts[long_], size) + inner]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        short = words[ends[k] - counts[k]:ends[k]]
        out[out_ends[k] - 1] = gram_hashes(short, len(short))[0] ^ np.uint64(len(short))
    return out, amount


def set_key(own: np.ndarray) -> bytes:
    """Key of a sorted array of distinct shingle hashes; equal sets have equal keys."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(5))
    factors = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            grams, amount = shingles(data, offsets, n)
            ends = np.cumsum(amount)
            full = np.flatnonzero(amount > 0)
            starts = (ends - amount)[full]
            least = np.empty((len(full), bands * rows), np.uint64)
            for k in range(bands * rows if len(full) else 0):
                least[:, k] = np.minimum.reduceat(grams * factors[k] + shifts[k], starts)
            band = np.zeros((len(full), bands), np.uint64)
            for k in range(rows):
                band = mix(band * np.uint64(0x9FB21C651E98DF25) + least[:, k::rows])
            keys, sizes = [], np.empty(len(full), np.int32)
            for at, (a, b) in enumerate(zip(starts.tolist(), ends[full].tolist())):
                own = np.unique(grams[a:b])
                sizes[at] = len(own)
                keys.append(set_key(own))
            hashes = pa.ListArray.from_arrays(
                pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)),
                pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [records.column("doc_id").take(pa.array(full)), pa.array(keys, pa.binary()),
                 pa.array(sizes), hashes], names=["doc_id", "set_key", "n_grams", "bands"])

    return sign


def _incidence(grams: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, column) of the shingles that two or more documents have; sizes of the sets."""
    doc = np.repeat(np.arange(len(amount)), amount)
    order = np.lexsort((doc, grams))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    sizes = np.bincount(doc, minlength=len(amount))
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else first
    return doc[shared], np.unique(column[shared], return_inverse=True)[1], sizes


def linked(grams: np.ndarray, amount: np.ndarray, threshold: float) -> np.ndarray:
    """Symmetric boolean matrix: whose sets have a Jaccard similarity of ``threshold`` or more."""
    doc, column, sizes = _incidence(grams, amount)
    common = np.zeros((len(amount), len(amount)), np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        x = np.zeros((len(amount), min(_COLUMNS, last - low)), np.float32)
        x[doc[a:b], column[a:b] - low] = 1
        common += x @ x.T
    total = sizes[:, None] + sizes[None, :]
    found = common.astype(np.float64) * (1 + threshold) >= threshold * total - 1e-9
    np.fill_diagonal(found, False)
    return found


def _verify(n: int, threshold: float):
    def verify(group):
        batch = group.combine_chunks().to_batches()[0]
        (records, data, offsets), = chunks(iter([batch]), "text", 1 << 62)
        grams, amount = shingles(data, offsets, n)
        ends = np.cumsum(amount)
        # a row is its class's text once: another text or a repeated row of the id goes
        keys, use, seen = records.column("set_key").to_pylist(), [], set()
        for at, (a, b) in enumerate(zip((ends - amount).tolist(), ends.tolist())):
            if keys[at] not in seen and set_key(np.unique(grams[a:b])) == keys[at]:
                seen.add(keys[at])
                use.append(at)
        use = np.array(sorted(use, key=keys.__getitem__), np.int64)
        keys = [keys[at] for at in use]
        copies, block = (records.column(c).to_numpy()[use] for c in ("copies", "block"))
        grams = np.concatenate([grams[ends[at] - amount[at]:ends[at]] for at in use] or [grams[:0]])
        found = linked(grams, amount[use], threshold)
        if records.column("low")[0] != records.column("high")[0]:
            found &= block[:, None] != block[None, :]    # pairs within a block are another group's
        links, label = found @ copies, np.arange(len(use))
        while True:
            least = np.minimum(label, np.where(found, label[None, :], len(use)).min(1, initial=len(use)))
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(links > 0)
        return pa.table({"set_key": pa.array([keys[k] for k in some], pa.binary()),
                         "links": pa.array(links[some].astype(np.int64)),
                         "label": pa.array([keys[label[k]] for k in some], pa.binary())})

    return verify


def ngram_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD,
               recall: float = RECALL, doc_id: str = "doc_id", text: str = "text",
               block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links``, one row per document.

    ``class_id`` is the smallest id that the document reaches through links
    (similarity of ``threshold`` or more), ``copy_of`` the smallest id with the same
    shingle set, ``n_links`` the number of other documents linked with it, copies
    included.
    """
    bands, rows = choose_bands(threshold, recall)
    source = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull())
    signed = materialize(source.mapInArrow(
        _signatures(n, bands, rows),
        "doc_id bigint, set_key binary, n_grams int, bands array<bigint>"), "signatures")
    members = signed.groupBy("set_key", "doc_id").agg(F.max("n_grams").alias("n_grams"))
    classes = materialize(members.groupBy("set_key").agg(
        F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"),
        F.max("n_grams").alias("n_grams")), "classes")

    # candidate links: every class of a bucket to the bucket's smallest
    bucket = signed.join(classes, "set_key").where("doc_id = copy_of").select(
        "set_key", F.posexplode("bands").alias("band", "hash"))
    hubs = bucket.groupBy("band", "hash").agg(
        F.min("set_key").alias("u"), F.max("set_key").alias("last")).where("u < last")
    edges = bucket.join(hubs.select("band", "hash", "u"), ["band", "hash"]).select(
        "u", F.col("set_key").alias("v"))
    groups = connected_components(edges).select(
        F.col("node").alias("set_key"), F.col("component").alias("group"))
    candidates = materialize(groups.join(classes, "set_key"), "candidates")

    # all against all within a group of candidates, by pairs of blocks
    sizes = candidates.groupBy("group").agg(F.greatest(
        F.count("*") / block_docs, F.sum(F.col("n_grams").cast("long") * 8) / block_bytes)
        .alias("blocks")).select("group", F.greatest(F.lit(1), F.ceil("blocks")).cast("int").alias("blocks"))
    dealt = candidates.join(sizes, "group").select(
        "set_key", "copy_of", "copies", "group", "blocks",
        F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block"))
    texts = source.join(dealt.hint("shuffle_hash"), F.col("doc_id") == F.col("copy_of"))
    paired = texts.select(
        "set_key", "copies", "text", "group", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "set_key", "copies", "text", "group", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    verified = materialize(paired.groupBy("group", "low", "high").applyInArrow(
        _verify(n, threshold), "set_key binary, links bigint, label binary"), "links")
    discard(candidates)

    links = verified.groupBy("set_key").agg(F.sum("links").alias("links"))
    found = materialize(
        connected_components(verified.select(F.col("set_key").alias("u"), F.col("label").alias("v")))
        .select(F.col("node").alias("set_key"), "component"), "linked")
    heads = found.join(classes, "set_key").groupBy("component").agg(F.min("copy_of").alias("class_id"))
    # written, so that a class with very many copies can be split in the join with its members
    per_class = materialize(
        classes.join(links, "set_key", "left")
        .join(found.join(heads, "component"), "set_key", "left")
        .select("set_key", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "per-class")
    joined = members.join(per_class, "set_key").select("doc_id", "class_id", "copy_of", "n_links")
    alone = source.select("doc_id").distinct().join(members, "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
        F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of one document per group of linked documents: the group's smallest id.

    Rows with a null id stay. Where an id is used by several rows, each row counts as a document of
    its own (in the order of id, then of a hash of the text): a text linked with no other stays, and of
    repeated rows one does.
    """
    own = free_prefix(docs)
    named = docs.where(F.col(doc_id).isNotNull())
    repeated = named.groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        return _without_followers(docs, doc_id, text, own, options)
    at, words = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    numbered = global_row_number(positional(named), [F.col(at), F.xxhash64(words)], "place")
    kept = _without_followers(numbered, "place", words, "_v", options).drop("place")
    return kept.toDF(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))


def _without_followers(docs: DataFrame, doc_id: str, text: str, own: str, options: dict) -> DataFrame:
    """The rows whose id is the smallest of its group, or null; ids are unique."""
    joined = ngram_join(docs, doc_id=doc_id, text=text, **options)
    gone = joined.groupBy("doc_id").agg(F.min("class_id").alias("least")).where(
        "least <> doc_id").select(F.col("doc_id").alias(f"{own}gone"))
    return docs.join(gone, docs[doc_id] == gone[f"{own}gone"], "left_anti")
