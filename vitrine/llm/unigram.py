"""SentencePiece encoding and decoding: Viterbi over a double-array trie of scored pieces.

A text is normalised as the vocabulary asks (spaces become the white-space marker,
one is put before a non-empty text) and split into the pieces whose scores sum
highest; of equal sums the split found first, from left to right, stays. A character
that no piece covers costs ``unknown`` and is written as its UTF-8 byte pieces (or
as the unknown piece where the vocabulary has none). Decoding joins the pieces,
turns markers into spaces and drops the first one.

No piece has a marker after another character, so a text falls apart before every
run of spaces: a task splits a chunk into such units, runs the search once per
distinct unit, all units in step, and copies the result to every occurrence. A unit
longer than ``LONG_UNIT`` bytes (scripts without spaces, encoded data) falls apart
further, wherever no piece that occurs in it spans a place: the best split has a
border there. What stays longer is searched one by one. The trie's alphabet is bytes,
with 0x20 for the marker.

Defined results: a null text has null tokens, an empty one none; the marker character
itself, in a text, is a character that no piece covers, so its byte pieces bring it
back (a vocabulary without them loses it); rows with null or repeated ids are each
encoded; an empty table gives no rows; columns that clash
with an added one must be renamed first, the operator refuses them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.arrays import bounded_batches, chunks, prefix_hashes, runs, substring_hashes
from vitrine.llm.folds import positional

MARKER = "▁"
SPACE = 0x20
UNKNOWN_PENALTY = 10.0
LONG_UNIT = 192
WALK = 1 << 18               # places whose pieces are looked up at once
CHUNK_BYTES = 2 << 20
_CHAR_BYTES = np.ones(256, np.int64)           # bytes of a character by its first byte
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores as arrays, small enough to travel with every task."""

    base: np.ndarray        # double array: the child of ``s`` by byte ``b`` is base[s] + b ...
    check: np.ndarray       # ... if check[base[s] + b] == s
    piece: np.ndarray       # state -> piece id, or -1
    scores: np.ndarray      # piece id -> log score
    byte_ids: np.ndarray    # byte -> piece id, or -1
    unknown_id: int
    unknown: float          # score of a character outside the pieces
    longest: int            # bytes of the longest piece
    surface: list[bytes]    # piece id -> bytes it decodes to
    prefix: bool = True     # put a marker before a text


def read_vocabulary(path: str) -> Vocabulary:
    """Read a model file with the sentencepiece library, on the driver only."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    rows = [(model.id_to_piece(k), model.get_score(k),
             "byte" if model.is_byte(k) else "unknown" if model.is_unknown(k)
             else "control" if model.is_control(k) or model.is_unused(k) else "normal")
            for k in range(model.get_piece_size())]
    return build_vocabulary(rows)


def build_vocabulary(rows: list[tuple[str, float, str]]) -> Vocabulary:
    """From (piece, score, kind) by id; kind is normal, byte, unknown or control."""
    normal = {}
    byte_ids = np.full(256, -1, np.int64)
    unknown_id, surface = 0, []
    for k, (text, _, kind) in enumerate(rows):
        raw = text.replace(MARKER, " ").encode()
        if kind == "normal" and raw:
            if b" " in raw.lstrip(b" "):
                raise ValueError(f"piece {text!r} has a marker after another character")
            normal.setdefault(raw, k)
            surface.append(raw)
        elif kind == "byte":
            byte_ids[int(text[1:-1], 16)] = k
            surface.append(bytes([int(text[1:-1], 16)]))
        else:
            unknown_id = k if kind == "unknown" else unknown_id
            surface.append(" ⁇ ".encode() if kind == "unknown" else b"")
    scores = np.array([s for _, s, _ in rows], np.float64)
    base, check, piece = _double_array(normal)
    low = min((scores[k] for k in normal.values()), default=0.0)
    return Vocabulary(base, check, piece, scores, byte_ids, unknown_id, low - UNKNOWN_PENALTY,
                      max(map(len, normal), default=1), surface)


def _double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place a trie's nodes so that one addition and one comparison follow an edge."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for raw, k in pieces.items():
        node = 0
        for b in raw:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][b]
        value[node] = k
    size = len(children) * 3 + 4096
    base, check, piece = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
    taken = bytearray(size)
    taken[0] = 1
    state, queue, free, dense = {0: 0}, [0], 1, 1
    for node in queue:
        piece[state[node]] = value[node]
        edges = sorted(children[node])
        if not edges:
            continue
        if len(edges) == 1:                  # any free slot will do
            while taken[free] or free <= edges[0]:
                free += 1
            at = free - edges[0]
        else:                                # from where slots are not yet crowded
            at = tried = dense
            while any(taken[at + b] for b in edges):
                at += 1
            if at - tried > 32:
                dense += (at - dense) // 2
        base[state[node]] = at
        for b in edges:
            child = children[node][b]
            state[child] = at + b
            taken[at + b] = 1
            check[at + b] = state[node]
            queue.append(child)
    end = max(state.values()) + 512
    return base[:end].copy(), check[:end].copy(), piece[:end].copy()


def occurrences(v: Vocabulary, data: np.ndarray, places: np.ndarray, ends: np.ndarray
                ) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(index into ``places``, bytes, piece ids) of the pieces that start at the places and
    end by ``ends``, shorter ones first; the trie is followed from all places in step."""
    active, state = np.arange(len(places)), np.zeros(len(places), np.int32)
    for size in range(1, v.longest + 1):
        on = places[active] + size <= ends[active]
        active, state = active[on], state[on]
        after = v.base[state] + data[places[active] + size - 1]
        on = v.check[after] == state
        active, state = active[on], after[on]
        if not len(active):
            return
        k = v.piece[state]
        hit = k >= 0
        if hit.any():
            yield active[hit], size, k[hit]


def borders(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places within the units ``starts:ends`` that no piece occurring there spans."""
    found = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        reach = a
        for low in range(a, b, WALK):
            places = low + np.flatnonzero((data[low:min(low + WALK, b)] & 0xC0) != 0x80)
            if not len(places):
                continue
            to = np.minimum(places + _CHAR_BYTES[data[places]], b)
            for on, size, _ in occurrences(v, data, places, np.full(len(places), b)):
                to[on] = np.maximum(to[on], places[on] + size)
            to = np.maximum(np.maximum.accumulate(to), reach)
            before = np.append(reach, to[:-1])
            found.append(places[(before <= places) & (places > a)])
            reach = int(to[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def split_one(v: Vocabulary, unit: bytes) -> list[int]:
    """Ids of one unit by a search from left to right over the pieces that occur in it."""
    n, data = len(unit), np.frombuffer(unit, np.uint8)
    best, before, ids = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    unknown = v.unknown
    for low in range(0, n, WALK):
        places = np.arange(low, min(low + WALK, n))
        rows = list(occurrences(v, data, places, np.full(len(places), n)))
        place, size, piece = (np.concatenate(c) if rows else np.zeros(0, np.int64) for c in (
            [r[0] for r in rows], [np.full(len(r[0]), r[1]) for r in rows], [r[2] for r in rows]))
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(len(places) + 1)).tolist()
        size, score, piece = (c[order].tolist() for c in (size, v.scores[piece], piece))
        widths = np.minimum(_CHAR_BYTES[data[places]], n - places).tolist()
        for k, width in enumerate(widths):
            s = low + k
            if best[s] == -np.inf:
                continue
            single = False
            for j in range(bounds[k], bounds[k + 1]):
                single |= size[j] == width
                t = s + size[j]
                if best[s] + score[j] > best[t]:
                    best[t], before[t], ids[t] = best[s] + score[j], s, piece[j]
            if not single and best[s] + unknown > best[s + width]:
                best[s + width], before[s + width], ids[s + width] = best[s] + unknown, s, -1
    out, at = [], n
    while at > 0:
        s, k = before[at], ids[at]
        if k >= 0:
            out.append(k)
        elif (v.byte_ids[list(unit[s:at])] >= 0).all():
            out.extend(int(v.byte_ids[b]) for b in reversed(unit[s:at]))
        else:
            out.append(v.unknown_id)
        at = s
    return out[::-1]


def split_units(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and how many each unit has.

    Units are sorted by length, longest first, so those that reach a position are
    a slice; position by position every one of them extends its best split.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    slots = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
    total = int((lengths + 1).sum())
    best = np.full(total, -np.inf)
    back = np.zeros(total, np.int32)              # bytes of the last piece
    ids = np.full(total, -1, np.int32)
    best[slots] = 0.0
    by_byte = (v.byte_ids >= 0).all()
    reach = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1 if len(lengths) else 0), "left")
    for s in range(len(reach) - 1):
        lanes = np.arange(reach[s]) if s == 0 else np.flatnonzero(best[slots[:reach[s]] + s] > -np.inf)
        lanes = lanes[lengths[lanes] > s]
        if not len(lanes):
            continue
        all_lanes, score = lanes, best[slots[lanes] + s]
        width = np.minimum(_CHAR_BYTES[data[starts[lanes] + s]], lengths[lanes] - s)
        single = np.zeros(len(lanes), bool)
        active = np.arange(len(lanes))
        state = np.zeros(len(lanes), np.int32)
        for t in range(s, s + v.longest):
            after = v.base[state] + data[starts[lanes[active]] + t]
            on = v.check[after] == state
            active, state = active[on], after[on]
            if not len(active):
                break
            k = v.piece[state]
            hit = k >= 0
            if hit.any():
                who, k = active[hit], k[hit]
                single[who[width[who] == t + 1 - s]] = True
                value, target = score[who] + v.scores[k], slots[lanes[who]] + t + 1
                better = value > best[target]
                target = target[better]
                best[target], back[target], ids[target] = value[better], t + 1 - s, k[better]
            longer = lengths[lanes[active]] > t + 1
            active, state = active[longer], state[longer]
            if not len(active):
                break
        lost = ~single
        if lost.any():
            lanes, width = all_lanes[lost], width[lost]
            value, target = score[lost] + v.unknown, slots[lanes] + s + width
            better = value > best[target]
            lanes, width, target = lanes[better], width[better], target[better]
            best[target], back[target], ids[target] = value[better], width, v.unknown_id
            if by_byte:            # the character's bytes, each with a slot of its own
                for k in range(4):
                    inside = width > k
                    slot = slots[lanes[inside]] + s + k + 1
                    back[slot] = 1
                    ids[slot] = v.byte_ids[data[starts[lanes[inside]] + s + k]]
    at, lanes, steps = lengths.copy(), np.flatnonzero(lengths > 0), []
    counts = np.zeros(len(lengths), np.int64)
    while len(lanes):
        slot = slots[lanes] + at[lanes]
        steps.append((lanes, ids[slot]))
        counts[lanes] += 1
        at[lanes] -= back[slot]
        lanes = lanes[at[lanes] > 0]
    final = np.empty_like(counts)
    final[order] = counts
    ends = np.cumsum(final)[order]
    out = np.empty(int(final.sum()), np.int32)
    for step, (lanes, k) in enumerate(steps, start=1):
        out[ends[lanes] - step] = k
    return out, final


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_chunk(v: Vocabulary, data: np.ndarray, offsets: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, one after the other, and how many each has."""
    sizes = np.diff(offsets)
    if v.prefix:
        full = sizes > 0
        data = np.insert(data, offsets[:-1][full], SPACE)
        sizes = sizes + full
        offsets = np.concatenate(([0], np.cumsum(sizes)))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    # a unit starts where a run of spaces does; line ends are units of their own
    classes = np.zeros(len(data), np.uint8)
    classes[data == SPACE] = 1
    classes[data == 0x0A] = 2
    starts, _, kinds = runs(classes, offsets)
    follows = (kinds[1:] == 0) & (kinds[:-1] == 1)
    inner = np.isin(starts[1:], offsets[1:-1])
    keep = np.concatenate(([True], ~(follows & ~inner)))
    starts = starts[keep]
    ends = np.append(starts[1:], len(data))
    wide = ends - starts > LONG_UNIT
    if wide.any():
        starts = np.union1d(starts, borders(v, data, starts[wide], ends[wide]))
        ends = np.append(starts[1:], len(data))
    _, first, inverse = np.unique(substring_hashes(prefix_hashes(data), starts, ends),
                                  return_index=True, return_inverse=True)
    starts_, lengths = starts[first], ends[first] - starts[first]
    long_ = np.flatnonzero(lengths > LONG_UNIT)
    lengths_short = lengths.copy()
    lengths_short[long_] = 0
    ids, counts = split_units(v, data, starts_, lengths_short)
    if len(long_):
        extra = [split_one(v, data[starts_[k]:starts_[k] + lengths[k]].tobytes()) for k in long_]
        at = np.cumsum(counts) - counts
        at[long_] = len(ids) + np.cumsum([0, *map(len, extra)])[:-1]
        counts[long_] = [len(x) for x in extra]
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in extra]])
    else:
        at = np.cumsum(counts) - counts
    per_unit = counts[inverse]
    units = np.diff(np.searchsorted(starts, offsets))
    totals = np.concatenate(([0], np.cumsum(per_unit)))
    edges = np.concatenate(([0], np.cumsum(units)))
    return ids[_gather(at[inverse], per_unit)], totals[edges[1:]] - totals[edges[:-1]]


def decode_chunk(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bytes of each document's ids, without the marker put before a text."""
    lengths = np.array([len(s) for s in v.surface])
    flat = np.frombuffer(b"".join(v.surface), np.uint8)
    at = np.cumsum(lengths) - lengths
    size = lengths[ids]
    raw = flat[_gather(at[ids], size)].tobytes()
    totals = np.concatenate(([0], np.cumsum(size)))
    edges = np.concatenate(([0], np.cumsum(counts)))
    bounds = totals[edges]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(raw[a + 1:b] if v.prefix and raw[a:a + 1] == b" " else raw[a:b])
    return out


def encode_texts(docs: DataFrame, v: Vocabulary, text: str = "text", ids: str = "token_ids"
                 ) -> DataFrame:
    """The rows with their token ids in a new column ``ids`` (array of int)."""
    if ids.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table already has a column {ids!r}")

    plain, at = positional(bounded_batches(docs)), f"c{docs.columns.index(text)}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks([batch], at, CHUNK_BYTES):
                found, counts = encode_chunk(v, data, offsets)
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                null = rows.column(rows.schema.get_field_index(at)).is_null()
                column = pa.ListArray.from_arrays(bounds, pa.array(found), mask=null)
                yield rows.append_column("ids", column)

    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(encode, schema).toDF(*docs.columns, ids)


def decode_tokens(rows: DataFrame, v: Vocabulary, ids: str = "token_ids", text: str = "decoded"
                  ) -> DataFrame:
    """The rows with the texts of their token ids in a new column ``text``.

    Null ids give a null text; bytes that are no UTF-8 become U+FFFD.
    """
    if text.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"the table already has a column {text!r}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            found = decode_chunk(v, column.flatten().to_numpy(zero_copy_only=False), counts)
            texts = [None if null else raw.decode("utf-8", "replace")
                     for raw, null in zip(found, column.is_null().to_pylist())]
            yield batch.append_column(text, pa.array(texts, pa.string()))

    return bounded_batches(rows).mapInArrow(decode, T.StructType([*rows.schema.fields,
                                                 T.StructField(text, T.StringType())]))


def token_digests(docs: DataFrame, v: Vocabulary, doc_id: str = "doc_id", text: str = "text"
                  ) -> DataFrame:
    """Encode and decode every text; keep counts and digests instead of the tokens.

    ``doc_id, n_tokens, n_byte_tokens`` (longs), ``ids_sha256`` (of the ids as
    little-endian 32-bit integers), ``round_trip`` (the decoded text is the text).
    A null text counts as empty.
    """
    is_byte = np.zeros(len(v.surface), bool)
    is_byte[v.byte_ids[v.byte_ids >= 0]] = True

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks([batch], "text", CHUNK_BYTES):
                ids, counts = encode_chunk(v, data, offsets)
                decoded = decode_chunk(v, ids, counts)
                edges = np.concatenate(([0], np.cumsum(counts)))
                flags = np.concatenate(([0], np.cumsum(is_byte[ids])))
                raw, source = ids.astype("<i4").tobytes(), data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(counts),
                    pa.array(flags[edges[1:]] - flags[edges[:-1]]),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest()
                              for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]),
                    pa.array([source[a:b] == found for a, b, found in
                              zip(offsets[:-1].tolist(), offsets[1:].tolist(), decoded)]),
                ], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    plain = bounded_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, n_byte_tokens bigint, "
                                    "ids_sha256 string, round_trip boolean")
