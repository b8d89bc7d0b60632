"""Exact search for repeated windows of a corpus: sampled anchors first, content second.

A document is a sequence of symbols (bytes or words); a window is ``window``
consecutive symbols. Every window has an anchor, the ``gram`` symbols with the
least hash in it, and equal windows have equal anchors at the same place. So

1. every document's anchors (about 2 / (window - gram + 2) per symbol) are sent by
   hash to reducers as compressed integers, which send the repeated ones back;
2. every document cuts out pieces around its repeated anchors: neighbouring windows
   that share one. Pieces go to the reducer of their anchor, which therefore
   sees every occurrence of all their windows and finds what is to be removed;
3. spans go back by document and are applied to its text.

Equal anchors and equal pieces are merged within a pack of texts before anything is
sent, so a passage that a third of all documents share costs a reducer one entry per
pack. Texts are shuffled once: both joins read the same exchange. Anchors are
compared by a hash of ``bits`` bits, where a collision only adds a candidate; windows
are compared by content or by 64-bit hashes.

A row is identified by its id and a hash of its text. Ids are integers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import bounded_batches, chunks, mix, release_memory

PART_BYTES = 8 << 20         # text per reducer: its pieces and their windows fit a small worker
SHELVES = 16
PACK_ANCHORS = 400_000
PACK_PIECE_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
SLICE = 1 << 22              # symbols handled at once
POSITION_BITS = 23
_DATA, _READY = 0, 1
_ROUTED = "part int, kind int, data binary"
_KEYED = "doc_id bigint, text_key bigint, payload binary"


# -- arrays as compressed binary values ------------------------------------------------

def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, equal places of their items together, compressed."""
    parts = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sq", raw, at)
        at += struct.calcsize("<2sq")
        kind = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


# -- anchors ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """Numbers that every stage shares."""

    window: int
    gram: int
    parts: int               # reducers
    bits: int                # of an anchor's hash
    within: bool = True      # repeats within one document count

    def value(self, hashes: np.ndarray) -> np.ndarray:
        """An anchor's value, spread evenly: the hashes themselves are small, being minima."""
        return (mix(hashes * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def part_of_value(self, values: np.ndarray) -> np.ndarray:
        return ((values >> (self.bits - 31)) * self.parts) >> 31

    def shelf_of_value(self, values: np.ndarray) -> np.ndarray:
        """A part's anchors in SHELVES groups, which a reducer takes one after the other."""
        within = ((values >> (self.bits - 31)) * self.parts) & ((1 << 31) - 1)
        return (within * SHELVES) >> 31

    def part_of_doc(self, doc_ids: np.ndarray) -> np.ndarray:
        mixed = doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int64) % self.parts


def pieces(grams: np.ndarray, offsets: np.ndarray, layout: Layout
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows whose anchors have one hash: document, first and last window
    start, that hash, whether it stands at several places.

    ``grams`` has the hash of the ``gram`` symbols from every position (those that
    run past a document's end are not looked at). In a text that repeats itself, such as
    a run of one byte, every window has an anchor of its own but all have the same hash:
    they share pieces of as many windows as one place can serve, instead of a piece each.
    """
    spread = layout.window - layout.gram + 1
    place = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= spread:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < spread:
        least = np.minimum(least[:size - spread], least[spread - size:])
    amount = np.maximum(np.diff(offsets) - layout.window + 1, 0)
    starts = gather(offsets[:-1], amount)
    anchor = (least[starts] & place).astype(np.int64)
    doc = np.repeat(np.arange(len(amount)), amount)
    value = grams[anchor]
    first = np.ones(len(starts), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    run = np.diff(np.append(at, len(starts)))
    if len(run) and run.max() > spread:
        times = -(-run // spread)
        at = np.repeat(at, times) + spread * gather(np.zeros(len(run), np.int64), times)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    return doc[at], starts[at], starts[last], value[at], anchor[at] != anchor[last]


def slices(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(from, to, offsets within, place in the document) of at most SLICE symbols.

    Only a document that is longer by itself is cut; the parts overlap.
    """
    total = int(offsets[-1])
    if total <= SLICE:
        yield 0, total, offsets, 0
        return
    for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for low in range(a, max(b - overlap, a + 1), SLICE - overlap):
            high = min(low + SLICE, b)
            inner = np.zeros(len(offsets), np.int64)
            inner[doc + 1:] = high - low
            yield low, high, inner, low - a


@dataclass(frozen=True)
class Symbols:
    """A slice of a chunk's symbols."""

    grams: np.ndarray        # hash of the ``gram`` symbols from each position
    offsets: np.ndarray      # document bounds within the slice
    base: int                # place in its document of the slice's first symbol, if it was cut
    own: np.ndarray          # the symbols: bytes, or hashes of words


# -- the documents a task holds --------------------------------------------------------

@dataclass
class Pack:
    """Rows gathered by a task: keys of its documents and arrays by document number."""

    ids: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    columns: list = field(default_factory=list)
    rows: int = 0
    size: int = 0

    def add(self, records: pa.RecordBatch, doc: np.ndarray, *columns: np.ndarray, size: int) -> None:
        self.ids.append(records.column("doc_id").to_numpy())
        self.keys.append(records.column("text_key").to_numpy())
        self.columns.append((doc + self.rows, *columns))
        self.rows += records.num_rows
        self.size += size

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return (np.concatenate(self.ids), np.concatenate(self.keys),
                [np.concatenate(c) for c in zip(*self.columns)])


def routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())],
        names=["part", "kind", "data"])


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, row numbers in their order) of the parts that have rows."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.unique(part):
        yield int(k), order[bounds[k]:bounds[k + 1]]


def to_documents(layout: Layout, doc: np.ndarray, doc_ids: np.ndarray, text_keys: np.ndarray,
                 *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Entries for documents as (part, data) by the documents' parts.

    ``doc`` numbers each entry's document; entries are sorted by document and the
    first column, so that keys are written once and differences are small.
    """
    order = np.lexsort((columns[0], doc))
    doc, columns = doc[order], [c[order] for c in columns]
    out = []
    for part, rows in by_part(layout.part_of_doc(doc_ids)[doc], layout.parts):
        used, counts = np.unique(doc[rows], return_counts=True)
        out.append((part, squeeze(doc_ids[used], text_keys[used], counts.astype(np.int32),
                                  np.diff(columns[0][rows], prepend=0),
                                  *(c[rows] for c in columns[1:]))))
    return out


def ready(layout: Layout, salt: int, *entry: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The same as rows that reducers hand on; they are dealt evenly, whatever their part."""
    return [((salt + k) % layout.parts, _READY, struct.pack("<i", part) + data)
            for k, (part, data) in enumerate(to_documents(layout, *entry))] if len(entry[0]) else []


def reduced(group: pa.Table) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    """The data of a reducer's group, and the entries that are ready."""
    kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
    return ([d for k, d in zip(kinds, data) if k == _DATA],
            [(struct.unpack_from("<i", d)[0], d[4:]) for k, d in zip(kinds, data) if k == _READY])


def entries(rows: list[tuple[int, bytes]]) -> pa.Table:
    release_memory()
    parts, data = zip(*rows) if rows else ((), ())
    return pa.table({"part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})


# -- stage 1: repeated anchors ---------------------------------------------------------

def _repeated(value: np.ndarray, owner: np.ndarray, within: bool) -> np.ndarray:
    """Of entries sorted by value and owner, those whose value occurs again, in another
    document unless ``within``."""
    if not len(value):
        return np.zeros(0, bool)
    new = np.append(True, value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(value)) - 1
    return (tails > heads if within else owner[tails] != owner[heads])[np.cumsum(new) - 1]


def _anchors(symbols: Callable, layout: Layout):
    def flush(pack: Pack, salt: int) -> Iterator[pa.RecordBatch]:
        if not pack.columns:
            return
        ids, keys, (doc, value) = pack.arrays()
        order = np.lexsort((doc, ids[doc], value))
        doc, value = doc[order], value[order]
        lead, once = np.ones(len(value), bool), _repeated(value, ids[doc], layout.within)
        lead[1:] = value[1:] != value[:-1]
        once[1:] &= lead[1:] | (doc[1:] != doc[:-1])       # each document once
        rows = ready(layout, salt, doc[once], ids, keys, value[once])
        doc, value = doc[lead], value[lead]
        for part, at in by_part(layout.part_of_value(value), layout.parts):
            used, number = np.unique(doc[at], return_inverse=True)
            rows.append((part, _DATA, squeeze(np.diff(value[at], prepend=0), number.astype(np.int32),
                                              ids[used], keys[used])))
        yield routed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, salt = Pack(), 0
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            found = []
            for part in symbols(data, offsets, layout):
                doc, _, _, anchor, several = pieces(part.grams, part.offsets, layout)
                again = np.repeat(np.arange(len(doc)), 1 + several)
                found.append((doc[again], layout.value(anchor)[again]))
            doc, value = (np.concatenate(c) for c in zip(*found))
            pack.add(records, doc, value, size=len(doc))
            if pack.size >= PACK_ANCHORS:
                yield from flush(pack, salt)
                pack, salt = Pack(), salt + 1
        yield from flush(pack, salt)

    return run


def _repeated_anchors(layout: Layout):
    def run(group):
        data, out = reduced(group)
        found = [unsqueeze(d) for d in data]
        if found:
            value = np.concatenate([np.cumsum(f[0]) for f in found])
            source = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            number = np.concatenate([f[1] for f in found])
            base = np.cumsum([0, *(len(f[2]) for f in found)])
            doc = base[source] + number
            ids, keys = (np.concatenate([f[k] for f in found]) for k in (2, 3))
            order = np.lexsort((ids[doc], value))
            value, doc = value[order], doc[order]
            twice = _repeated(value, ids[doc], layout.within)
            value, doc = value[twice], doc[twice]
            out += to_documents(layout, doc, ids, keys, value) if len(doc) else []
        return entries(out)

    return run


def _per_document(merge: Callable):
    """Entries of a part as one payload per document."""
    def run(group):
        found = [unsqueeze(d) for d in group.column("data").to_pylist()]
        ids, keys = (np.concatenate([np.repeat(f[k], f[2]) for f in found]) for k in (0, 1))
        columns = [np.concatenate([np.cumsum(f[3]) for f in found]),
                   *(np.concatenate(c) for c in zip(*(f[4:] for f in found)))]
        order = np.lexsort((*reversed(columns), keys, ids))
        ids, keys, columns = ids[order], keys[order], [c[order] for c in columns]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(ids))
        payloads = [merge(*(c[a:b] for c in columns)) for a, b in zip(at.tolist(), ends.tolist())]
        return pa.table({"doc_id": ids[at], "text_key": keys[at],
                         "payload": pa.array(payloads, pa.binary())})

    return run


# -- stage 2: pieces around repeated anchors ---------------------------------------------

def _short(values: np.ndarray) -> np.ndarray:
    """Anchor values as a document keeps them; equal low bits only add a candidate."""
    return (values & 0xFFFFFFFF).astype(np.uint32)


def flagged(records: pa.RecordBatch, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the anchor value is among the document's repeated ones."""
    column = records.column("payload")
    sizes = np.array([len(p) // 4 for p in column.to_pylist()], np.int64)
    known = np.frombuffer(b"".join(column.to_pylist()), np.uint32)
    value = _short(value)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((known, owner))
    known, owner = known[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out = np.zeros(len(doc), bool)
    edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
    for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(bounds) > 0)):
        own, mine = known[bounds[k]:bounds[k + 1]], value[edges[k]:edges[k + 1]]
        at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
        out[edges[k]:edges[k + 1]] = own[at] == mine
    return out


def remove_repeats(docs: DataFrame, window: int, gram: int, symbols: Callable, cut: Callable,
                   solve: Callable, apply: Callable, schema: str, within: bool = True) -> DataFrame:
    """Run the three stages over ``docs`` (``doc_id`` bigint, ``text``).

    Repeats count ``within`` one document too, or only between documents.

    ``symbols(data, offsets, layout)`` yields ``Symbols``; ``cut(layout)`` makes the
    function of stage 2 over texts with a ``payload`` of repeated anchors,
    ``solve(layout)`` the reducer of its pieces, ``apply`` the function that turns texts
    with a ``payload`` of (start, end) pairs into rows of ``schema``.
    """
    spark = docs.sparkSession
    plain = bounded_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    known = plain.where(F.col("doc_id").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(window, gram, max(2 * spark.sparkContext.defaultParallelism,
                                      math.ceil(size / PART_BYTES)),
                    min(60, max(32, math.ceil(math.log2(size + 2)) + 8)), within)

    def by_parts(rows: DataFrame):
        """Groups by part in as many tasks as parts, so that a task does not grow with the input."""
        return rows.repartition(layout.parts, "part").groupBy("part")

    anchors = known.mapInArrow(_anchors(symbols, layout), _ROUTED)
    found = by_parts(anchors).applyInArrow(_repeated_anchors(layout), "part int, data binary")
    repeated = by_parts(found).applyInArrow(
        _per_document(lambda v: np.unique(_short(v)).tobytes()), _KEYED)

    # one exchange of the texts serves both joins
    dealt = known.repartition(layout.parts, "doc_id", "text_key")
    cuts = dealt.join(repeated.hint("shuffle_hash"), ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "text", "payload").mapInArrow(cut(layout), _ROUTED)
    solved = by_parts(cuts).applyInArrow(solve(layout), "part int, data binary")
    spans = by_parts(solved).applyInArrow(_per_document(merged), _KEYED)
    judged = dealt.join(spans.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select(
        "doc_id", "text", "payload").mapInArrow(apply, schema)
    unnamed = plain.where(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit(None).cast("binary").alias("payload")).mapInArrow(apply, schema)
    return judged.unionByName(unnamed)


def merged(starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Union of spans sorted by start, as (start, end) pairs of 64-bit integers."""
    ends = np.maximum.accumulate(starts + lengths)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([starts[at], ends[np.append(at[1:], len(starts)) - 1]]).astype(
        np.int64).tobytes()


def span_pairs(payload: bytes | None) -> np.ndarray:
    return np.frombuffer(payload or b"", np.int64).reshape(-1, 2)
