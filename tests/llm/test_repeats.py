"""Substring and byte-string deduplication against brute force."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from tests.llm import helpers
from vitrine.llm.repeats import Layout, merged, pieces, span_pairs, squeeze, unsqueeze
from vitrine.llm.substring_dedup import deduplicate_substrings, factors_of, greedy_factors
from vitrine.llm.suffix_dedup import (_symbols, maximal_intervals, remove_repeated_bytes,
                                      suffix_array)

WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def expected(of, rows, window):
    by_row = of(rows, window)
    return collections.Counter(by_row[r] for r in rows if r[0] is not None)


def named(df, columns):
    return helpers.rows_of(df.where("doc_id IS NOT NULL"), *columns)


@pytest.mark.parametrize("window,gram", [(20, 8), (6, 2), (1, 1)])
def test_words_equal_brute_force(spark, window, gram):
    rows = helpers.corpus()
    got = deduplicate_substrings(helpers.documents(spark, rows), window=window, gram=gram,
                                 with_text=False)
    assert named(got, WORDS) == expected(helpers.substring_dedup, rows, window)
    assert got.where("doc_id IS NULL AND n_removed = 0").count() == 2


@pytest.mark.parametrize("length,gram", [(50, 16), (12, 5)])
def test_bytes_equal_brute_force(spark, length, gram):
    rows = helpers.corpus(seed=2)
    got = remove_repeated_bytes(helpers.documents(spark, rows), length=length, gram=gram,
                                with_bytes=False)
    assert named(got, BYTES) == expected(helpers.repeated_bytes, rows, length)
    assert got.where("doc_id IS NULL AND n_removed = 0").count() == 2


def test_queries_equal_brute_force_on_driver_data(spark):
    from vitrine.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert helpers.rows_of(QUERIES["op6_substring_dedup"](spark, d), *WORDS) == expected(
        helpers.substring_dedup, rows, 20)
    assert helpers.rows_of(QUERIES["op10_suffix_array_dedup"](spark, d), *BYTES) == expected(
        helpers.repeated_bytes, rows, 50)


def test_kept_text_spans_and_odd_columns(spark):
    shared = " ".join(f"s{k}" for k in range(25))
    df = spark.createDataFrame([(1, shared, b"x"), (2, f"a  {shared}\nb", b"y")],
                               "doc_id int, text string, payload binary")
    got = {r.doc_id: r for r in deduplicate_substrings(df).collect()}
    assert got[2].text == "a b" and got[2].spans == [[1, 26]] and got[1].spans == []
    found = {r.doc_id: r for r in remove_repeated_bytes(df).collect()}
    assert bytes(found[2].kept) == b"a  \nb" and found[2].spans == [[3, 3 + len(shared)]]
    renamed = df.select(df.doc_id.alias("key"), df.text.alias("body"))
    assert deduplicate_substrings(renamed, "key", "body").where("n_removed = 25").count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], helpers.SCHEMA)
    assert deduplicate_substrings(empty).collect() == []
    assert remove_repeated_bytes(empty).collect() == []


def test_very_long_text_and_large_group_of_copies(spark):
    long_ = " ".join(f"v{k % 3000}" for k in range(60000))
    rows = [(k, "same line of words that many documents hold here " * 3) for k in range(1, 400)]
    rows += [(500, long_), (501, long_[:5000])]
    got = deduplicate_substrings(helpers.documents(spark, rows), with_text=False)
    assert named(got, WORDS) == expected(helpers.substring_dedup, rows, 20)
    got = remove_repeated_bytes(helpers.documents(spark, rows), with_bytes=False)
    assert named(got, BYTES) == expected(helpers.repeated_bytes, rows, 50)


def test_texts_longer_than_a_slice(monkeypatch):
    from vitrine.llm import repeats, substring_dedup
    text = np.frombuffer(helpers.prose(__import__("random").Random(3), 500).encode(), np.uint8)
    offsets = np.array([0, len(text)])
    layout = Layout(20, 8, 4, 40)

    def found():
        return {(int(f) + s.base, int(v)) for s in substring_dedup._symbols(text, offsets, layout)
                for d, a, b, h, _ in [pieces(s.grams, s.offsets, layout)]
                for lo, hi, v in zip(a, b, layout.value(h)) for f in range(lo, hi + 1)}

    whole = found()
    monkeypatch.setattr(repeats, "SLICE", 90)
    assert found() == whole and len({p for p, _ in whole}) == 481


def test_helpers():
    a, b = np.array([5, -1, 2**62]), np.array([1, 2, 3], np.uint8)
    x, y = unsqueeze(squeeze(a, b))
    assert (x == a).all() and (y == b).all() and y.dtype == np.uint8
    assert span_pairs(merged(np.array([0, 3, 10]), np.array([5, 4, 2]))).tolist() == [[0, 7], [10, 12]]


def test_intervals_are_the_maximal_repeats():
    text = b"xabcabcabdyabcabd"
    content = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text))
    order, common = suffix_array(content, starts, np.full(len(text), len(text)))
    left = [256 if p == 0 else text[p - 1] for p in order]
    found = {}
    for low, high, depth in maximal_intervals(common.tolist(), left, 2):
        places = sorted(int(p) for p in order[low:high + 1])
        found[text[places[0]:places[0] + depth]] = places
    expect = {}
    for i in range(len(text)):
        for n in range(2, len(text) - i + 1):
            s = text[i:i + n]
            at = [p for p in range(len(text)) if text.startswith(s, p)]
            lefts = {text[p - 1] if p else None for p in at}
            rights = {text[p + n] if p + n < len(text) else (None, p) for p in at}
            if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                expect[s] = at
    assert found == expect


def brute_factors(texts, window):
    """Greedy parse by trying every earlier start: (start, words) of each factor."""
    out = []
    for n, text in enumerate(texts):
        found, p = [], 0
        while p < len(text):
            best = 0
            for m, other in enumerate(texts[:n + 1]):
                for q in range(len(other) if m < n else p):
                    size = 0
                    while (p + size < len(text) and q + size < len(other)
                           and text[p + size] == other[q + size]):
                        size += 1
                    best = max(best, size)
            if best >= window:
                found.append((p, best))
                p += best
            else:
                p += 1
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_factors_equal_a_brute_force_parse(seed):
    rng = __import__("random").Random(seed)
    texts = [[f"w{rng.randrange(3)}" for _ in range(rng.randrange(60))] for _ in range(6)]
    texts += [texts[0][5:40] + texts[1][:30] + texts[2][3:], ["a"] * 40, ["b"] + ["a"] * 30, []]
    got = factors_of(texts, window=4)
    assert [[f[:2] for f in found] for found in got] == brute_factors(texts, 4)
    for number, found in enumerate(got):
        for start, size, origin, there in found:
            assert (origin, there) < (number, start)
            assert texts[number][start:start + size] == texts[origin][there:there + size]


def test_windows_over_a_factors_end_are_looked_up():
    """A longest factor hides a window that another source has: it is removed all the same."""
    a, b = [f"a{k}" for k in range(6)], [f"b{k}" for k in range(6)]
    texts = [a + ["x"], a[3:] + b[:3], a + b]
    got = factors_of(texts, window=4)
    assert [f[:2] for f in got[2]] == [(0, 6)]
    length = np.array([3, 2, 1, 1, 1, 0, 0, 0, 0])       # of a + b: windows 3 and 4 cross the end
    _, crossing = greedy_factors(length, np.arange(9, 0, -1), np.zeros(9, np.int64), 4)
    assert crossing.tolist() == [False] * 3 + [True] * 3 + [False] * 3


def test_runs_are_few_pieces():
    layout = Layout(50, 16, 4, 40)
    for text in (b"A" * 200_000, b"ab" * 100_000):
        data = np.frombuffer(text, np.uint8)
        offsets = np.array([0, 100_000, 100_000, 200_000])
        part, = _symbols(data, offsets, layout)
        doc, first, last, value, _ = pieces(part.grams, part.offsets, layout)
        size = last - first + layout.window
        assert int(size.sum()) < 2.5 * len(text) and len(np.unique(value)) == 1
        assert int((last - first + 1).sum()) == 2 * (100_000 - 49)
        assert (first >= part.offsets[doc]).all()
        assert (last + layout.window <= part.offsets[doc + 1]).all()


def test_runs_equal_brute_force(spark):
    rng = __import__("random").Random(8)
    rows = [(1, "A" * 900), (2, "x" + "A" * 700 + "y" + "A" * 60), (3, "ab" * 500), (4, "b" + "ab" * 300),
            (5, "the " * 600), (6, "of the " * 300 + "the " * 400), (7, "=" * 49), (8, "=" * 51),
            (9, "-" * 60 + "=" * 3000), (10, "A" * 400 + helpers.prose(rng, 30) + "A" * 300),
            (11, "of the " * 500)]
    got = remove_repeated_bytes(helpers.documents(spark, rows), with_bytes=False)
    assert named(got, BYTES) == expected(helpers.repeated_bytes, rows, 50)
    got = deduplicate_substrings(helpers.documents(spark, rows), with_text=False)
    assert named(got, WORDS) == expected(helpers.substring_dedup, rows, 20)
