"""Spectrum slicing against a dense eigensolver, and the whitening query against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vitrine.llm import whitening as wh
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, x string"


def symmetric(seed, values):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_the_eigenvalues_over_the_shift(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(17, 17))
    a = a + a.T if seed % 2 else np.kron(np.eye(17)[:1].T @ np.eye(17)[:1], 1) + (a > 1) + (a > 1).T
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[1:] + values[:-1]) / 2, values[0] - 1, values[-1] + 1]:
        if np.abs(values - shift).min() > 1e-8:
            assert wh.positive_pivots(a, shift) == (values > shift).sum()
    assert wh.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("values", [
    np.arange(1, 25.0), np.geomspace(1e-9, 1e6, 20), [5, 5, 5, 2, 2, 1, 0, 0], [3.0], [1, 1 + 1e-9, 1 + 2e-9, 4],
    [-4, -1, 0, 2, 7]])
def test_slices_equal_a_dense_solver(values):
    v = symmetric(3, np.array(values, float))
    v = (v + v.T) / 2
    found = wh.leading_eigenpairs(v, 8)
    expected = np.sort(values)[::-1][:8]
    norm = np.abs(values).max()
    assert np.allclose([s.value for s in found], expected, rtol=0, atol=1e-12 * norm)
    for number, s in enumerate(found, 1):
        assert np.linalg.norm(v @ s.vector - s.value * s.vector) < 1e-12 * norm * len(v)
        assert s.above < number <= s.below
    w = np.array([s.vector for s in found])
    assert np.allclose(w @ w.T, np.eye(len(w)), atol=1e-12)


def expected_rows(rows, k=16):
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in e]) for i, e in rows
            if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[(a * n - s) / n for a, s in zip(x, sums)] for x in fit])
    v = off.T @ off / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    out = []
    for i, x in kept:
        c = np.array([(a * n - s) / n for a, s in zip(x, sums)])
        deviation = sum((a * n - s) ** 2 for a, s in zip(x, sums))
        out.append((i, n, deviation, c @ vectors[:, order] / np.sqrt(values[order]),
                    values[order] / np.trace(v)))
    return out


def test_query_equals_plain_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    expected = {e[0]: e for e in expected_rows([(r.vec_id, r.embedding) for r in table])}
    assert len(rows) == 16 * len(expected)
    got = {(r.vec_id, r.component): r for r in rows}
    for i, n, deviation, whitened, shares in expected.values():
        for k in range(16):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert math.isclose(r.explained, shares[k], rel_tol=1e-9)
            assert math.isclose(abs(r.whitened), abs(whitened[k]), rel_tol=1e-6, abs_tol=1e-6)
            assert 0 <= r.identity_error < 1e-9
    # one sign per component
    for k in range(16):
        signs = {np.sign(got[i, k + 1].whitened * e[3][k]) for i, e in expected.items()
                 if abs(e[3][k]) > 1e-3}
        assert len(signs) == 1


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=3)], "extra") for i in range(40)]
    odd = [(100, None, ""), (101, [1.0, None, 2.0], ""), (102, [float("nan"), 0.0, 0.0], ""),
           (103, [float("inf"), 0.0, 0.0], ""), (104, [float("-inf"), 0.0, 1.0], ""), (105, [], ""), (106, [1.0], ""),
           (None, good[0][1], ""), (0, good[0][1], ""), (0, good[1][1], None)]
    frame = spark.createDataFrame([*good, *odd], SCHEMA).repartition(3)
    rows = wh.whiten(frame).collect()
    expected = expected_rows([(i, e) for i, e, _ in [*good, *odd[-3:]]])
    assert len(rows) == 3 * len(expected)
    key = lambda t: (t[0] is None, t[0] or 0, t[1])                       # noqa: E731
    assert sorted({(r.vec_id, r.deviation) for r in rows}, key=key) == sorted(
        {(e[0], e[2]) for e in expected}, key=key)


def test_no_spread_and_empty(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5], "") for i in range(5)], SCHEMA)
    assert wh.whiten(same).count() == 0
    empty = wh.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "component"]
    flat = spark.createDataFrame([(i, [float(i % 4), 1.0], "") for i in range(8)], SCHEMA)
    assert {r.component for r in wh.whiten(flat).collect()} == {1}


def test_huge_entries_stay_exact(spark):
    rows = [(i, [3e30 if i == 0 else float(i), -1e12 * i], "") for i in range(4)]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 8 and all(r.whitened is not None for r in got)
    model = wh.Whitening(10**7, [10**13 + 3], 1.0, [])
    _, part, rest = model.centred(np.array([[10**6], [10**6 + 40]]))
    assert model.deviations(part, rest) == [9, (40 * 10**7 - 3) ** 2]
