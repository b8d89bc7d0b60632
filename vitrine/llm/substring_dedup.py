"""Duplicate passages by relative Lempel-Ziv parsing against indexed reference blocks.

A word is covered by a duplicate if a window of ``window`` consecutive words that
holds it also starts earlier: in a document with a smaller id, or before it in the
same document. The corpus is its own reference, divided into blocks by the hash of
the windows' anchors (see ``repeats``). A block indexes the windows it receives by
their earliest place and parses every piece greedily, left to right: where the text
goes on with a known window, the factor is the longest stretch that also starts
earlier anywhere in the block (whichever source has it), and parsing goes on after
its end; other words are literals. Factors, being of a window or more, become
duplicate spans. Windows that cross a factor's end are looked up in the index one by
one, since a factor that starts earlier can hide them: those that are known become
spans too. A window has one anchor, so no other block can know it.

Words are runs of characters other than ASCII white space. Defined results: null,
empty and blank texts have no words; shorter documents than a window lose nothing;
rows with a null id are returned whole and duplicate nothing; of equal texts the
smallest id stays; rows that share an id count as one document: only a smaller start
is earlier there; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import chunks, gram_hashes, mix, word_hashes
from vitrine.llm.repeats import (CHUNK_BYTES, PACK_PIECE_BYTES, Layout, Pack, Symbols, _DATA,
                                 by_part, entries, flagged, gather, pieces, ready, reduced,
                                 remove_repeats, routed, slices, span_pairs, squeeze,
                                 to_documents, unsqueeze)

WINDOW = 20
GRAM = 8


def _symbols(data: np.ndarray, offsets: np.ndarray, layout: Layout) -> Iterator[Symbols]:
    words, counts = word_hashes(data, offsets)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for low, high, inner, base in slices(bounds, layout.window - 1):
        own = words[low:high]
        yield Symbols(gram_hashes(own, layout.gram), inner, base, own)


def _cut(layout: Layout):
    def flush(pack: Pack, salt: int) -> Iterator[pa.RecordBatch]:
        if not pack.columns:
            return
        ids, keys, (doc, place, size, value, content) = pack.arrays()
        starts = np.cumsum(size) - size
        if not len(doc):
            return
        inside = np.arange(len(content)) - np.repeat(starts, size)
        same = mix(np.add.reduceat(mix(content + inside.astype(np.uint64)), starts))
        order = np.lexsort((place, ids[doc], same))
        lead = np.ones(len(doc), bool)
        lead[1:] = same[order[1:]] != same[order[:-1]]
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))]
        later = order[(ids[doc[order]] != ids[doc[head]]) | (place[order] != place[head])]
        rows = ready(layout, salt, doc[later], ids, keys, place[later],
                     size[later] + layout.window - 1)
        at = order[lead]
        for part, of in by_part(layout.part_of_value(value[at]), layout.parts):
            rows_at = at[of]
            used, number = np.unique(doc[rows_at], return_inverse=True)
            rows.append((part, _DATA, squeeze(
                number.astype(np.int32), place[rows_at], size[rows_at].astype(np.int32),
                content[gather(starts[rows_at], size[rows_at])], ids[used], keys[used])))
        yield routed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, salt = Pack(), 0
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            for part in _symbols(data, offsets, layout):
                doc, first, last, anchor, _ = pieces(part.grams, part.offsets, layout)
                value = layout.value(anchor)
                on = flagged(records, doc, value)
                doc, first, last, value = doc[on], first[on], last[on], value[on]
                size = last - first + 1
                windows = gram_hashes(part.own, layout.window)
                pack.add(records, doc, first - part.offsets[doc] + part.base, size, value,
                         windows[gather(first, size)], size=8 * int(size.sum()))
            if pack.size >= PACK_PIECE_BYTES:
                yield from flush(pack, salt)
                pack, salt = Pack(), salt + 1
        yield from flush(pack, salt)

    return run


def longest_matches(window: np.ndarray, room: np.ndarray, owner: np.ndarray, at: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretch from every window that also starts earlier, and where.

    ``window`` has the windows of the block's pieces in their order, ``room`` how many
    are left in the piece from each on, ``owner`` and ``at`` the document and place of
    its start. Returned are lengths in windows (0: the window is not known from
    earlier) and row numbers of the earliest sources. Stretches of n windows are told
    apart by those of n - 1 and the last window; a stretch that occurs once drops out.
    """
    length, source = np.zeros(len(window), np.int64), np.arange(len(window))
    single = np.unique(window, return_inverse=True)[1].astype(np.int64)
    rows = np.lexsort((at, owner))               # earliest first
    key = single[rows]
    kinds = int(single.max()) + 1 if len(single) else 1
    n = 1
    while len(rows):
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        lead = rows[new][group]
        known = (owner[lead] != owner[rows]) | (at[lead] != at[rows])
        length[rows[known]] = n
        source[rows[known]] = lead[known]
        on = (np.bincount(group)[group] > 1) & (room[rows] > n)
        rows, key = rows[on], group[on] * kinds + single[rows[on] + n]
        n += 1
    return length, source


def greedy_factors(length: np.ndarray, room: np.ndarray, piece: np.ndarray, window: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Rows where factors start, parsing every piece from the left, all pieces in step, and
    whether each window crosses a factor's end without lying in another factor."""
    total = len(length)
    ahead = np.where(length > 0, np.arange(total), total)
    ahead = np.append(np.minimum.accumulate(ahead[::-1])[::-1], total)
    end = np.arange(total) + room                # of the piece, in windows
    cursor = np.flatnonzero(np.diff(piece, prepend=-1) != 0)
    stop = end[cursor] if total else cursor
    taken, crossing = [], np.zeros(total + 1, np.int64)
    while len(cursor):
        found = ahead[cursor]
        on = found < stop
        found, stop = found[on], stop[on]
        taken.append(found)
        inner = found + length[found]            # first window that leaves the factor
        cursor = np.minimum(inner + window - 1, stop)
        np.add.at(crossing, inner, 1)
        np.add.at(crossing, cursor, -1)
        on = cursor < stop
        cursor, stop = cursor[on], stop[on]
    return (np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64),
            np.cumsum(crossing[:-1]) > 0)


def _parse(layout: Layout):
    """Reference block: index the windows received, parse the pieces against it."""
    def run(group):
        data, out = reduced(group)
        found = [unsqueeze(d) for d in data]
        if found:
            base = np.cumsum([0, *(len(f[4]) for f in found)])
            doc = np.concatenate([f[0] + b for f, b in zip(found, base)])
            place, size, window = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
            ids, keys = (np.concatenate([f[k] for f in found]) for k in (4, 5))
            size = size.astype(np.int64)
            piece = np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
            at, room, owner = place[piece] + inside, size[piece] - inside, ids[doc[piece]]
            del found, data, inside
            length, _ = longest_matches(window, room, owner, at)
            factors, crossing = greedy_factors(length, room, piece, layout.window)
            # windows over a factor's end that the index knows, neighbours as one span
            known = crossing & (length > 0)
            lead = known.copy()
            lead[1:] &= ~known[:-1] | (piece[1:] != piece[:-1])
            first = np.flatnonzero(lead)
            runs = np.bincount(np.cumsum(lead)[known] - 1, minlength=len(first))
            rows = np.concatenate([factors, first])
            if len(rows):
                words = np.concatenate([length[factors], runs]) + layout.window - 1
                out += to_documents(layout, doc[piece[rows]], ids, keys, at[rows], words)
        return entries(out)

    return run


def factors_of(texts: list[list[str]], window: int = WINDOW) -> list[list[tuple[int, int, int, int]]]:
    """The parse of some texts, given as words, that a block holds whole: for each its factors
    (start, words, number of the source text, start there). A text's sources are the ones
    before it and its own earlier words."""
    names: dict[tuple, int] = {}
    size = np.array([max(len(t) - window + 1, 0) for t in texts], np.int64)
    grams = np.array([names.setdefault(tuple(t[k:k + window]), len(names))
                      for t, n in zip(texts, size.tolist()) for k in range(n)], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    length, source = longest_matches(grams, size[owner] - at, owner, at)
    found, _ = greedy_factors(length, size[owner] - at, owner, window)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for row in found.tolist():
        origin = source[row]
        out[owner[row]].append((int(at[row]), int(length[row]) + window - 1,
                                int(owner[origin]), int(at[origin])))
    return out


def kept_words(text: bytes, payload: bytes | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    words = text.split()
    removed = 0
    kept, at = [], 0
    for a, b in span_pairs(payload).tolist():
        kept.extend(words[at:a])
        removed += b - a
        at = b
    kept.extend(words[at:])
    return len(words), removed, b" ".join(kept)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, data, offsets in chunks(batches, "text", CHUNK_BYTES):
            raw = data.tobytes()
            payloads = records.column("payload").to_pylist()
            found = [kept_words(raw[a:b], p) for a, b, p in
                     zip(offsets[:-1].tolist(), offsets[1:].tolist(), payloads)]
            columns = [records.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                       pa.array([f[1] for f in found], pa.int64())]
            if with_text:
                columns += [pa.array([f[2].decode() for f in found], pa.string()),
                            pa.array([span_pairs(p).tolist() for p in payloads],
                                     pa.list_(pa.list_(pa.int64())))]
            else:
                columns.append(pa.array([hashlib.sha256(f[2]).hexdigest() for f in found]))
            yield pa.RecordBatch.from_arrays(columns, names=_names(with_text))

    return run


def _names(with_text: bool) -> list[str]:
    return ["doc_id", "n_words", "n_removed", *(["text", "spans"] if with_text else ["kept_sha256"])]


def deduplicate_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           window: int = WINDOW, gram: int = GRAM, with_text: bool = True
                           ) -> DataFrame:
    """``doc_id, n_words, n_removed`` per row, with the kept ``text`` (words joined by one
    space) and the removed word ``spans``, or with ``kept_sha256`` of that text instead."""
    if not 1 <= gram <= window:
        raise ValueError("a gram has at least one word and at most a window's")
    kinds = ["bigint"] * 3 + (["string", "array<array<bigint>>"] if with_text else ["string"])
    schema = ", ".join(f"{n} {k}" for n, k in zip(_names(with_text), kinds))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return remove_repeats(plain, window, gram, _symbols, _cut, _parse, _apply(with_text), schema)
