"""The pipeline over planted documents against plain Python; clashing names; repeated ids; linear scans."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest

import corpus_pipeline
from tests.llm import helpers
from vitrine.llm import unigram
from vitrine.llm.decontaminate import MIN_SHARE, MIN_TOKENS, WINDOW, benchmark_overlaps
from vitrine.llm.ngram_join import one_per_group
from vitrine.llm.oracle import DECONTAMINATION
from vitrine.llm.queries import VOCABULARY
from vitrine.llm.secrets import MASK, RULES, find_secrets

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\W_]+")


def plain_leaks(docs, items):
    """(doc_id, item_id) with a window of the item that the document has, place by place, but for a few tokens."""
    found, tokens = set(), {i: TOKEN.findall((t or "").lower()) for i, t in items}
    for d, text in docs:
        words = TOKEN.findall((text or "").lower())
        at = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        for i, item in tokens.items():
            size = min(WINDOW, len(item))
            if min(len(words), len(item)) < MIN_TOKENS:
                continue
            shifts = {}
            for k, w in enumerate(item):
                for p in at.get(w, ()):
                    shifts.setdefault(p - k, []).append(k)
            for places in shifts.values():
                if any(sum(a <= p < a + size for p in places) >= math.ceil(size * MIN_SHARE) for a in places):
                    found.add((d, i))
    return found


def plain_mask(text):
    for rule in RULES:
        def shown(m, rule=rule):
            return MASK if len(m.group(rule.group)) >= rule.min_length else m.group()
        text = re.sub(rule.pattern, shown, text)
    return text


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    long = [d for d in docs if d[1] and 60 < len(d[1].split()) < 400]
    passage = next(t for _, t in items if len(TOKEN.findall(t)) >= 15)
    words = long[0][1].split(" ")
    near = words[:len(words) // 2] + ["andere"] + words[len(words) // 2 + 1:]
    extra = [
        (9001, "12 34 !! 56", None), (9002, None, "en"), (9003, "", "en"),                  # no letter
        (9004, long[0][1], long[0][2]), (9005, " ".join(near), long[0][2]),                 # copies
        (9006, f"{long[1][1]} {passage} {long[1][1][:80]}", long[1][2]),                    # benchmark
        (9007, f"{' '.join(sorted(long[2][1].split()))} password = hunter2hunter2 {'ab12' * 8} AKIA{'Z9' * 10}", long[2][2]),   # secrets
        (9008, f"{long[3][1]} ▁ {long[3][1][::-1]}", long[3][2])]                     # marker
    rows = docs + [(i, t, lang, "planted", None if t is None else len(t)) for i, t, lang in extra]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_equals_plain_python(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    identified = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, folder).collect()}
    assert not identified & {9001, 9002, 9003} and {9004, 9005, 9006, 9007} <= identified
    assert len(identified) >= 0.97 * len(rows)
    kept = [r for r in rows if r[0] in identified]
    first = {i for (i, least, _) in helpers.jaccard_links([(r[0], r[1]) for r in kept]) if i == least}
    kept = [r for r in kept if r[0] in first]
    assert not {9004, 9005} & {r[0] for r in kept}
    leaked = {d for d, _ in plain_leaks([(r[0], r[1]) for r in kept], items)}
    assert 9006 in leaked
    kept = [(*r[:1], plain_mask(r[1]), *r[2:]) for r in kept if r[0] not in leaked]
    v = unigram.read_vocabulary(VOCABULARY)
    want = {r[0]: (*r, unigram.split_one(v, (" " + r[1].replace("▁", " ")).encode()) if r[1] else [])
            for r in kept}
    coded = corpus_pipeline.run(spark, folder)
    got = {r.doc_id: tuple(r) for r in coded.collect()}
    assert coded.columns == [*docs.columns, "token_ids"] and got.keys() == want.keys()
    for i, row in got.items():
        assert row[:5] == want[i][:5]
        assert row[5] == want[i][5] or "▁" in row[1]
    # decoding gives every text back, markers too
    assert unigram.decode_tokens(coded, v).where("NOT decoded <=> text").count() == 0
    assert MASK in got[9007][1] and "hunter2" not in got[9007][1]


CLASHES = ("_id", "_text", "_kinds", "_k", "_m_hex", "_s_hex", "_letters", "_gone", "_leaked", "_own_text", "_v", "_vid",
           "_rn_id", "place", "component", "kinds", "seed", "set_key", "with.dot", "H")


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_of_any_name(spark, planted, stage):
    from pyspark.sql import functions as F

    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 OR doc_id >= 9000")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    docs = docs.unionByName(docs.where("doc_id = 9007"))                # a repeated row
    out = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)


def test_a_clean_text_under_a_used_id_stays(spark):
    rng = random.Random(8)
    t, other, u = (helpers.prose(rng, 80, 5000) for _ in range(3))
    rows = [(1, t), (5, t), (5, other), (7, u), (7, u), (None, t), (None, t), (8, None), (8, None)]
    kept = one_per_group(helpers.documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [
        (1, t), (5, other), (7, u), (None, t), (None, t), (8, None), (8, None)]))


def test_matches_cost_the_same_in_a_long_text(spark):
    def seconds(n):
        text = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:24] for i in range(n))
        df = helpers.documents(spark, [(1, text)])
        began = time.time()
        row, = find_secrets(df).collect()
        spans = [tuple(s.split(":")[1:]) for s in row.spans.split(",")]
        assert spans == [(str(m.start()), str(m.end())) for m in re.finditer("[0-9a-f]{24,}", text)]
        return time.time() - began

    seconds(100)
    half, whole = seconds(16000), seconds(32000)
    assert whole < 20 and whole < 4 * half + 4


def test_sql_finds_every_planted_passage(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, helpers.prose(rng, 13 + i % 9, 100000)) for i in range(200)]
    docs = []
    for i, text in items:
        words = text.split(" ")
        at = rng.randrange(len(words) - 12)
        piece = words[at:at + 13]
        for k in rng.sample(range(13), 2):
            piece[k] = "changed"
        docs.append((i, " ".join([helpers.prose(rng, rng.randrange(30), 100000), *piece, helpers.prose(rng, 20, 100000)])))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[1][1]), (1002, items[1][1])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = helpers.rows_of(benchmark_overlaps(spark.read.parquet(f"{tmp_path}/documents.parquet"),
                                             spark.read.parquet(f"{tmp_path}/benchmark.parquet")),
                          "doc_id", "item_id", "n_match", "n_window")
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    sql = {tuple(r) for r in con.sql(DECONTAMINATION).fetchall()}
    assert sql == set(got) and {(i, i) for i in range(200)} <= {r[:2] for r in sql}
