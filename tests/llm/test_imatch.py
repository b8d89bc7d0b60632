"""Document fingerprints against plain Python, edits, neighbours and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import corpus, documents, prose
from vitrine.llm import imatch
from vitrine.llm.arrays import prefix_hashes, substring_hashes
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 29


def term_hash(word):
    data = np.frombuffer(word.lower(), np.uint8)
    return int(substring_hashes(prefix_hashes(data.astype(np.int64)), np.array([0]), np.array([len(data)]))[0])


def plain_terms(text):
    return {term_hash(w) for w in TERM.findall((text or "").encode())}


def sequence(hashes):
    return plain_mix(sum(plain_mix((h + (k + 1) * 0x9E3779B97F4A7C15) & M64) for k, h in enumerate(sorted(hashes))) & M64)


def plain_fingerprint(text, band):
    terms = plain_terms(text)
    kept = {h for h in terms if h >> 42 in band}
    few = len(kept) < imatch.FEW
    kept = terms if few else kept
    other = {h: plain_mix(h ^ 0xA5A5A5A55A5A5A5A) for h in kept}
    level = {h: min(((o >> 16) & -(o >> 16)).bit_length() - 1, 26) if o >> 16 else 26 for h, o in other.items()}
    own = next(k for k in range(26) if k == 25 or sum(v >= k for v in level.values()) <= imatch.TERMS)
    out = bytearray(imatch.WIDTH)
    if kept:
        out[:8] = sequence(kept).to_bytes(8, "big")
    out[8] = own + 32 * few
    for more in (0, 1):
        for slot in range(64):
            group = [h for h in kept if other[h] % 64 == slot and level[h] >= own + more]
            if group:
                out[9 + 64 * more + slot] = sequence(group) % 255 + 1
    return out.hex()


def plain_band(texts):
    count = {}
    for t in texts:
        for h in plain_terms(t):
            count[h >> 42] = count.get(h >> 42, 0) + 1
    n = len(texts)
    return {b for b, c in count.items() if n * math.exp(-imatch.MAX_IDF) <= c <= n * math.exp(-imatch.MIN_IDF)}


def plain_likeness(a, b):
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    if a[:9] == b[:9]:
        return 1.0
    if a[8] // 32 != b[8] // 32 or abs(a[8] % 32 - b[8] % 32) > 1:
        return 0.0
    top = max(a[8] % 32, b[8] % 32)
    x, y = (p[9:73] if p[8] % 32 == top else p[73:] for p in (a, b))
    return 2 * sum(i == j and i > 0 for i, j in zip(x, y)) / max(1, sum(map(bool, x)) + sum(map(bool, y)))


def expected(rows, sort_key):
    """Rows of the contract; copies count once in a small table."""
    text = {i: t or "" for i, t in rows}
    band = plain_band(sorted(set(text.values())))
    order, out = sorted(text, key=sort_key), {}
    for k, i in enumerate(order):
        own, following = text[i], text[order[(k + 1) % len(order)]]
        cut = len(own) // 4
        edited = own[:len(own) - cut] + following[:cut]
        a, b, c = (plain_fingerprint(t, band) for t in (own, edited, following))
        out[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                  plain_likeness(a, b), plain_likeness(a, c))
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_query_equals_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op11_document_fingerprints"](spark, SF).collect()
    assert len(found) == len(rows)
    want = expected(rows, lambda i: i)
    for r in found:
        assert tuple(r[c] for c in COLUMNS[:4]) == want[r.doc_id][:4]
        assert [r.near_edited, r.near_next] == pytest.approx(want[r.doc_id][4:])


def test_odd_rows(spark):
    rows = list({i: (i, t) for i, t in corpus(size=40)}.values())
    rows += [(3000, "word " * 60000), (3001, "\U0001F600 é 日本 " * 50), (3002, "!!! ??? ...")]
    found = imatch.compare_edited(documents(spark, rows)).collect()
    want = expected(rows, lambda i: (i is not None, i or 0))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS[:4]) for r in found} == {i: w[:4] for i, w in want.items()}
    assert len(found) == len(rows)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "aa bb cc dd ee ff gg hh"), (1, "aa bb cc dd ee ff gg hh"), (1, "other words here, more of them"),
            (2, "xx yy"), (None, "none"), (None, None)]
    found = imatch.compare_edited(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in found) == sorted(
        (i is None, i or 0, len(t or "")) for i, t in rows)
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add((r.fingerprint, r.edited_sha256))
    assert len(by_text[1, 23]) == 1
    assert imatch.compare_edited(documents(spark, [])).count() == 0
    alone, = imatch.compare_edited(documents(spark, [(7, "a single text of some words")])).collect()
    text = "a single text of some words"
    assert alone.edited_sha256 == hashlib.sha256((text[:21] + text[:6]).encode()).hexdigest()


def test_edits_are_near_and_others_are_not(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 250, 6000)) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]         # a third of all rows are copies
    found = {r.doc_id: r for r in imatch.compare_edited(documents(spark, rows)).collect()}
    assert len({found[1000 + i].fingerprint for i in range(150)} | {found[0].fingerprint}) == 1
    clean = [found[i] for i in range(299)]
    assert np.mean([r.near_edited for r in clean]) > 0.5 and min(r.near_edited for r in clean) > 0.15
    assert np.mean([r.near_next for r in clean]) < 0.1 and max(r.near_next for r in clean) < 0.4
    assert all(found[1000 + i].near_next == 1.0 for i in range(149))


def test_texts_cross_one_exchange(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["op11_document_fingerprints"](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert plan.count("MapInArrow") == 2 and "ReusedExchange" in plan and "CartesianProduct" not in plan
