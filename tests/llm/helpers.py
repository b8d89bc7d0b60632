"""Brute-force versions and fixtures for the text operators."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text) as a table like ``documents``, over several partitions."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, size=60):
    """Texts with copies, near copies, a shared passage, edge cases and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(size):
        text = prose(rng, rng.randrange(1, 160), 5000)
        if i % 5 == 1:
            text = text + " " + passage
        if i % 7 == 2 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 7 == 3 and rows and len(words(rows[-1][1])) > 40:
            parts = (rows[-1][1]).split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one two"), (1004, "one  two"),
             (1005, "ab " * 120), (1006, "é" * 130), (1007, "é" * 130), (1008, "x"),
             (1009, "日本語 " * 40), (None, "no id at all"), (None, None)]
    rows += [(2000, passage), (2000, passage)]          # a repeated row
    rows += [(-5, "tail " * 3 + passage)]
    return rows


def substring_dedup(rows, window=20):
    """Expected (doc_id, n_words, n_removed, kept_sha256) of distinct rows with ids."""
    first, out = {}, {}
    for i, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")):
        w = words(text)
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p:p + window]), (i, p)) != (i, p):
                gone[p:p + window] = b"\1" * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, text] = (i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(rows, length=50):
    first, out = {}, {}
    named = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    for i, text in named:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    for i, text in named:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, text] = (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                        hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, n=5):
    w = words(text)
    if len(w) >= n:
        return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    return frozenset([tuple(w)] if w else [])


def jaccard_links(rows, n=5, threshold=0.8):
    """Counter of expected (doc_id, class_id, n_links), one per (id, shingle set)."""
    sets = sorted({(i, shingle_set(t, n)) for i, t in rows if i is not None},
                  key=lambda r: (r[0], sorted(r[1])))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for a in range(len(sets)):
        least[find(a)] = min(least.get(find(a), sets[a][0]), sets[a][0])
    return collections.Counter((sets[a][0], least[find(a)], links[a]) for a in range(len(sets)))


def plain_split(v, raw):
    """Ids of the best split of ``raw`` from a dictionary of pieces, byte by byte."""
    special = {k for k in range(len(v.surface)) if k in set(v.byte_ids.tolist()) or k < 3}
    pieces = {}
    for k, piece in enumerate(v.surface):
        if k not in special:
            pieces.setdefault(piece, k)
    best, last = {0: 0.0}, {}
    for s in range(len(raw)):
        if s not in best:
            continue
        width = min(next(w for w, low in ((4, 0xF0), (3, 0xE0), (2, 0xC0), (1, 0)) if raw[s] >= low),
                    len(raw) - s)
        steps = [(raw[s:t], pieces[raw[s:t]]) for t in range(s + 1, min(len(raw), s + v.longest) + 1)
                 if raw[s:t] in pieces]
        if all(len(piece) != width for piece, _ in steps):
            steps.append((raw[s:s + width], -1))
        for piece, k in steps:
            value = best[s] + (v.scores[k] if k >= 0 else v.unknown)
            if value > best.get(s + len(piece), -math.inf):
                best[s + len(piece)], last[s + len(piece)] = value, (s, k)
    out, at = [], len(raw)
    while at:
        s, k = last[at]
        out[:0] = [k] if k >= 0 else [int(v.byte_ids[b]) for b in raw[s:at]]
        at = s
    return out


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
