"""N-gram join and connected components against brute force."""

from __future__ import annotations

import random

import pytest

from tests.llm import helpers
from vitrine.llm.components import connected_components
from vitrine.llm.ngram_join import choose_bands, ngram_join, one_per_group

COLUMNS = ("doc_id", "class_id", "n_links")


@pytest.mark.parametrize("block_docs", [1024, 3])
def test_equals_brute_force(spark, block_docs):
    rows = helpers.corpus(seed=4) + [(3000, "first text of an id"), (3000, "one two"), (3000, None)]
    rng = random.Random(9)
    base = helpers.prose(rng, 120).split(" ")
    for k in range(25):                                  # a group of near copies
        near = list(base)
        near[rng.randrange(len(near))] = f"edit{k}"
        rows.append((4000 + k, " ".join(near)))
    got = ngram_join(helpers.documents(spark, rows), block_docs=block_docs)
    named = [r for r in rows if r[0] is not None]
    expect = helpers.jaccard_links(named)
    expect = {k: v for k, v in expect.items() if not (k[0] == 3000 and k[1] == 3000 and k[2] == 0)}
    found = helpers.rows_of(got, *COLUMNS)
    found = {k: v for k, v in found.items() if not (k[0] == 3000 and k[1] == 3000 and k[2] == 0)}
    assert found == expect
    assert got.where("doc_id = 3000 AND n_links > 0").count() == 1


def test_query_on_driver_data(spark):
    from vitrine.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert helpers.rows_of(QUERIES["op9_ngram_jaccard_join"](spark, d), *COLUMNS) == \
        helpers.jaccard_links(rows)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= 96
    assert choose_bands(0.8) == (18, 5)
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.9999, 4)


def test_empty_and_filter(spark):
    assert ngram_join(spark.createDataFrame([], helpers.SCHEMA)).collect() == []
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "z")]
    df = helpers.documents(spark, rows).withColumnRenamed("source", "_gone")
    kept = one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + k, 1001 + k) for k in range(60)]          # a path
    edges += [(2000, 2001 + k) for k in range(100)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r.node: r.component for r in got.collect()} == label
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert connected_components(none).collect() == []
