"""Repeated byte strings found with an enhanced suffix array and its common-prefix intervals.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id. Documents are cut into pieces around repeated anchors (see
``repeats``); a reducer holds all occurrences of the strings of its anchors and

1. merges equal pieces, each with all its occurrences: a piece that two documents
   hold is a repeat as it stands;
2. builds the suffix array of the strings that start in two or more different pieces
   and differ, somewhere, in the byte before (others are part of a longer repeat that
   starts further left), with the common-prefix lengths of neighbours;
3. scans it with a stack: every interval of suffixes with a common prefix of
   ``length`` bytes or more whose left extensions differ is a maximal repeat group,
   given out with all its occurrences, not just neighbours.

Every occurrence of a group outside the smallest document becomes a span.

Texts are their UTF-8 bytes. Defined results: null texts are empty; documents shorter
than ``length`` lose nothing; rows with a null id are returned whole and duplicate
nothing; rows that share an id count as one document and do not duplicate each other;
of equal texts the smallest id stays; an empty table gives no rows; extra columns are
ignored. What remains need not be UTF-8, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import chunks, prefix_hashes, range_hashes, substring_hashes
from vitrine.llm.repeats import (CHUNK_BYTES, PACK_PIECE_BYTES, SHELVES, Layout, Pack, Symbols, _DATA,
                                 by_part, entries, flagged, gather, pieces, ready, reduced,
                                 remove_repeats, routed, slices, span_pairs, squeeze,
                                 to_documents, unsqueeze)

LENGTH = 50
GRAM = 16
_MIXED = 256          # left extensions that differ


def _symbols(data: np.ndarray, offsets: np.ndarray, layout: Layout) -> Iterator[Symbols]:
    for low, high, inner, base in slices(offsets, layout.window - 1):
        own = data[low:high]
        yield Symbols(range_hashes(prefix_hashes(own), layout.gram), inner, base, own)


def _cut(layout: Layout):
    def flush(pack: Pack, salt: int) -> Iterator[pa.RecordBatch]:
        if not pack.columns:
            return
        ids, keys, (doc, place, size, value, same, content) = pack.arrays()
        if not len(doc):
            return
        starts = np.cumsum(size) - size
        order = np.lexsort((place, doc, ids[doc], same))
        lead = np.ones(len(doc), bool)
        lead[1:] = same[order[1:]] != same[order[:-1]]
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))]
        least = ids[doc[order]] == ids[doc[head]]
        later = order[~least]             # a smaller document of the pack has the piece
        rows = ready(layout, salt, doc[later], ids, keys, place[later], size[later])
        at = order[least]
        for part, of in by_part(layout.part_of_value(value[at]), layout.parts):
            rows_at = at[of]
            used, number = np.unique(doc[rows_at], return_inverse=True)
            rows.append((part, _DATA, squeeze(
                number.astype(np.int32), place[rows_at], size[rows_at].astype(np.int32),
                content[gather(starts[rows_at], size[rows_at])], ids[used], keys[used],
                layout.shelf_of_value(value[rows_at]).astype(np.uint8))))
        yield routed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, salt = Pack(), 0
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            for part in _symbols(data, offsets, layout):
                doc, first, last, anchor, _ = pieces(part.grams, part.offsets, layout)
                value = layout.value(anchor)
                on = flagged(records, doc, value)
                doc, first, value = doc[on], first[on], value[on]
                size = last[on] - first + layout.window
                pack.add(records, doc, first - part.offsets[doc] + part.base, size, value,
                         substring_hashes(prefix_hashes(part.own), first, first + size),
                         part.own[gather(first, size)], size=int(size.sum()))
            if pack.size >= PACK_PIECE_BYTES:
                yield from flush(pack, salt)
                pack, salt = Pack(), salt + 1
        yield from flush(pack, salt)

    return run


def suffix_array(content: np.ndarray, starts: np.ndarray, ends: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common-prefix length of each with the one before it."""
    longest = int((ends - starts).max()) if len(starts) else 0
    width = -(-max(longest, 1) // 8) * 8
    padded = np.append(content, np.zeros(width, np.uint8))
    table = padded[starts[:, None] + np.arange(width)]
    table[np.arange(width) >= (ends - starts)[:, None]] = 0
    words = table.view(">u8")
    order = np.lexsort((ends - starts, *(words[:, k] for k in reversed(range(words.shape[1])))))
    table, size = table[order], (ends - starts)[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = table[1:] != table[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def maximal_intervals(common: list[int], left: list[int], least: int
                      ) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the common-prefix intervals of depth ``least`` or more whose
    left extensions differ; ``left`` is the byte before each suffix, or ``_MIXED`` if unknown."""
    stack: list[list[int]] = []
    for k in range(1, len(left) + 1):
        depth = common[k] if k < len(left) else 0
        first, byte = k - 1, left[k - 1]
        while stack and stack[-1][0] > depth:
            level, low, seen = stack.pop()
            byte = seen if seen == byte else _MIXED
            first = low
            if byte == _MIXED:
                yield first, k - 1, level
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != byte:
                stack[-1][2] = _MIXED
        elif depth >= least:
            stack.append([depth, first, byte])


def repeat_spans(content: np.ndarray, starts: np.ndarray, sizes: np.ndarray, smallest: np.ndarray,
                 length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (piece, from, size) of distinct pieces that a piece of a smaller document repeats."""
    amount = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), amount)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(amount) - amount, amount)
    at = starts[piece] + inside
    window = substring_hashes(prefix_hashes(content), at, at + length)
    left = np.where(inside > 0, content[np.maximum(at - 1, 0)].astype(np.int64), _MIXED)
    order = np.argsort(window, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = window[order[1:]] != window[order[:-1]]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    owner = smallest[piece[order]]
    low, high = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
    before = left[order]
    alike = np.minimum.reduceat(before, heads) == np.maximum.reduceat(before, heads)
    alike &= before[heads] != _MIXED
    use = order[((low < high) & ~alike)[group]]
    if not len(use):
        return (np.zeros(0, np.int64),) * 3
    sorted_, common = suffix_array(content, at[use], (starts + sizes)[piece[use]])
    use = use[sorted_]
    of, place, owner = piece[use], inside[use], smallest[piece[use]]
    found = []
    for first, last, depth in maximal_intervals(common.tolist(), left[use].tolist(), length):
        own = owner[first:last + 1]
        later = first + np.flatnonzero(own > own.min())
        if len(later):
            found.append((later, depth))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    later = np.concatenate([f for f, _ in found])
    return of[later], place[later], np.repeat([d for _, d in found], [len(f) for f, _ in found])


def _solve(layout: Layout):
    def solve(found: list, shelf: int) -> list[tuple[int, bytes]]:
        """Entries for the pieces on one shelf: strings on different shelves are never equal."""
        at = [np.flatnonzero(f[6] == shelf) for f in found]
        base = np.cumsum([0, *(len(f[4]) for f in found)])
        doc = np.concatenate([f[0][k] + b for f, k, b in zip(found, at, base)])
        if not len(doc):
            return []
        place = np.concatenate([f[1][k] for f, k in zip(found, at)])
        size = np.concatenate([f[2][k] for f, k in zip(found, at)]).astype(np.int64)
        content = np.concatenate([
            f[3][gather((np.cumsum(f[2], dtype=np.int64) - f[2])[k], f[2][k].astype(np.int64))]
            for f, k in zip(found, at)])
        ids, keys = (np.concatenate([f[k] for f in found]) for k in (4, 5))
        starts = np.cumsum(size) - size
        same = substring_hashes(prefix_hashes(content), starts, starts + size)
        order = np.lexsort((place, doc, ids[doc], same))
        new = np.ones(len(order), bool)
        new[1:] = same[order[1:]] != same[order[:-1]]
        distinct = np.cumsum(new) - 1                 # piece of each occurrence in order
        heads = order[new]
        smallest = ids[doc[heads]]
        owner = ids[doc[order]]
        whole = owner > smallest[distinct]
        spans = [(order[whole], np.zeros(int(whole.sum()), np.int64), size[order[whole]])]
        piece, inside, long_ = repeat_spans(content, starts[heads], size[heads], smallest,
                                            layout.window)
        # occurrences in the piece's smallest document; those elsewhere are whole spans
        rest = np.flatnonzero(~whole)
        bounds = np.searchsorted(distinct[rest], np.arange(len(heads) + 1))
        times = np.diff(bounds)[piece]
        spans.append((order[rest[gather(bounds[piece], times)]], np.repeat(inside, times),
                      np.repeat(long_, times)))
        hit, inside, long_ = (np.concatenate(c) for c in zip(*spans))
        return to_documents(layout, doc[hit], ids, keys, place[hit] + inside, long_) if len(hit) else []

    def run(group):
        data, out = reduced(group)
        found = [unsqueeze(d) for d in data]
        for shelf in range(SHELVES if found else 0):
            out += solve(found, shelf)
        return entries(out)

    return run


def _names(with_bytes: bool) -> list[str]:
    return ["doc_id", "n_bytes", "n_removed", "n_spans",
            *(["kept", "spans"] if with_bytes else ["kept_sha256"])]


def _apply(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            raw = memoryview(data.tobytes())
            pairs = [span_pairs(p) for p in records.column("payload").to_pylist()]
            kept = []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), pairs):
                at, left = a, []
                for low, high in spans.tolist():
                    left.append(raw[at:a + low])
                    at = a + high
                kept.append(b"".join([*left, raw[at:b]]))
            sizes = np.diff(offsets)
            columns = [records.column("doc_id"), pa.array(sizes),
                       pa.array(sizes - np.array([len(k) for k in kept], np.int64)),
                       pa.array([len(p) for p in pairs], pa.int64())]
            if with_bytes:
                columns += [pa.array(kept, pa.binary()),
                            pa.array([p.tolist() for p in pairs], pa.list_(pa.list_(pa.int64())))]
            else:
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
            yield pa.RecordBatch.from_arrays(columns, names=_names(with_bytes))

    return run


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True
                          ) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` per row, with the ``kept`` bytes and the
    removed ``spans``, or with ``kept_sha256`` instead."""
    if not 1 <= gram <= length:
        raise ValueError("a gram has at least one byte and at most a string's")
    kinds = ["bigint"] * 4 + (["binary", "array<array<bigint>>"] if with_bytes else ["string"])
    schema = ", ".join(f"{n} {k}" for n, k in zip(_names(with_bytes), kinds))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return remove_repeats(plain, length, gram, _symbols, _cut, _solve, _apply(with_bytes), schema,
                          within=False)
