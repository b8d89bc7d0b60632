"""Classifiers, language models and the tokenizer: held-out accuracy, exactness, edge cases."""

from __future__ import annotations

import collections
import itertools
import math
import pickle
import random
import zlib

import numpy as np
import pytest

from tests.llm import helpers
from vitrine.llm import language_id, quality_classifier, toxicity, unigram
from vitrine.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.01"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_held_out(spark, labels):
    rows = QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in rows)
    out = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in out) >= 0.95 * len(out)


def test_toxicity_held_out(spark, labels):
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.7) for r in rows)
    pairs = [(r.score, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.85
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)


def toxic_corpus(n):
    """Texts of clean words; one in ten also has one to three of five bad words."""
    rng = random.Random(3)
    clean = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    bad = ["zwirk", "grobz", "quonk", "vlurt", "skrag"]
    texts, toxic = [], []
    for k in range(n):
        toxic.append(k % 10 == 0)
        texts.append(" ".join(rng.choices(clean, k=12) + (rng.sample(bad, rng.randint(1, 3)) if toxic[-1] else [])))
    return texts, toxic


def test_toxicity_counts_every_document(spark):
    texts, toxic = toxic_corpus(60000)
    third = [texts[7]] * 30000                       # one text is a third of all rows
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + third)],
                                 "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60000, 40)] + [(5, 0), (None, 1)],
                                   "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, max_positive=1000)
    marked = rows.collect()
    assert len(marked) == 90000 and sum(r.positive for r in marked) == 1000
    n_pos, n_all = collections.Counter(), collections.Counter()
    for r in marked:
        for token in {w.encode() for w in r.text.split()} | {
                (w[:k].encode(), k) for w in r.text.split() for k in (4, 5) if len(w) > k}:
            n_all[token] += 1
            n_pos[token] += r.positive
    expected = {}
    for token, b in n_all.items():
        raw, scale = token if isinstance(token, tuple) else (token, 1)
        data = np.frombuffer(raw, np.uint8)
        value = toxicity.substring_hashes(toxicity.prefix_hashes(data), np.array([0]), np.array([len(data)]))
        bucket = int((value * np.uint64(scale) >> np.uint64(20))[0]) % toxicity.BUCKETS
        a, both = n_pos[token] / 1000, n_pos[token] + b
        pooled = both / 91000
        z = abs(a - b / 90000) / math.sqrt(pooled * (1.0001 - pooled) * (1 / 1000 + 1 / 90000))
        if both >= 5 and z > 4:
            expected[bucket] = (z, a, b / 90000)
    strongest = sorted(expected.values(), reverse=True)
    ratios = [b / a for _, a, b in strongest if a > b][:toxicity.STRONGEST]
    buckets, prior, documents = toxicity.choose_features(rows)
    assert documents == 90000 and set(buckets.tolist()) == set(expected)
    assert prior == pytest.approx(np.median(ratios)) and 0.04 < prior < 0.1      # 6,000 of 90,000
    model = toxicity.fit_toxicity(docs, labels, max_positive=1000, shard_documents=16000)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((scored[k] >= 0.5) == toxic[k] for k in range(60000))
    assert max(scored[k] for k in range(60000, 90000)) == scored[7] < 0.1


def test_toxicity_score_by_hand(spark):
    texts, toxic = toxic_corpus(3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 3000, 20)], "doc_id bigint, toxic int")
    one = toxicity.fit_toxicity(docs, labels, shard_documents=1000)
    two = toxicity.fit_toxicity(docs.repartition(5), labels, shard_documents=1000)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.bias, two.bias)
    rows = toxicity.score_toxicity(docs.where("doc_id < 50"), one).collect()
    for r in rows:
        features = set()
        for w in texts[r.doc_id].split():
            for part, scale in [(w, 1)] + [(w[:k], k) for k in (4, 5) if len(w) > k]:
                data = np.frombuffer(part.encode(), np.uint8)
                value = toxicity.substring_hashes(toxicity.prefix_hashes(data), np.array([0]), np.array([len(data)]))
                features.add(int(one.feature[int((value * np.uint64(scale) >> np.uint64(20))[0]) % toxicity.BUCKETS]))
        logits = [sum(w[f] for f in features if f >= 0) + b for w, b in zip(one.weights, one.bias)]
        assert r.score == pytest.approx(np.mean([1 / (1 + math.exp(-g)) for g in logits]))


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows.values())
    out = [(rows[d.doc_id].lang_pred, d.lang) for d in docs if rows[d.doc_id].held_out]
    assert sum(p == q for p, q in out) >= 0.97 * len(out)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "123 !!"), (5, "der die das und " * 2000),
       (None, "la casa de los"), (5, "the cat"), (6, "\U0001F600"), (7, "日本語")]


def odd_table(spark):
    return helpers.documents(spark, ODD).withColumnRenamed("source", "score")


def test_odd_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], helpers.SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (5, 1, 1), (5, 1, None), (None, 0, 1), (77, 1, 1)],
                                 "doc_id bigint, quality int, toxic int")
    for table, size in ((odd_table(spark), len(ODD)), (empty, 0)):
        for given in (none, some):
            for rows in (quality_classifier.classify_quality(table, given).collect(),
                         toxicity.classify_toxicity(table, given).collect()):
                assert len(rows) == size and all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify_languages(empty).collect() == []
    got = language_id.identify_languages(odd_table(spark))
    assert got.count() == len(ODD)
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert {1, 2, 3, 4} <= und
    blank = empty.withColumnRenamed("lang", "lang")
    unlabelled = odd_table(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}
    assert language_id.keep_identified(blank, None).collect() == []


def test_unlearned_languages_and_junk_are_rejected(spark):
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni "
              "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ")
    chinese = "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。"
    foreign = [polish, polish * 20, chinese, chinese * 20, "привет, как дела сегодня? " * 30,
               *["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60, 400, 5000)],
               "qzxjkvwq" * 200, "TGlmZSBpcyBnb29kIHRvZGF5IGFuZCBhbHdheXM" * 30]
    table = docs.unionByName(spark.createDataFrame(
        [(10**9 + k, t, None) for k, t in enumerate(foreign)], "doc_id bigint, text string, lang string"))
    tree = language_id.fit_context_tree(table)
    limits = language_id.fit_limits(table, tree)
    kept = {r.doc_id for r in language_id.keep_identified(table, tree, limits=limits).collect()}
    assert not {k for k in kept if k >= 10**9}
    assert len(kept) >= 0.995 * docs.count()
    beginnings = table.where("doc_id < 1000000000").selectExpr(
        "doc_id", "substr(text, 1, 20 + pmod(doc_id, 200)) AS text", "lang")
    short = language_id.keep_identified(beginnings, tree, limits=limits).count()
    assert short >= 0.97 * language_id.keep_identified(beginnings, tree).count()
    few = docs.limit(3)                      # too few to learn a limit from
    tree = language_id.fit_context_tree(few)
    assert language_id.keep_identified(few, tree, limits=language_id.fit_limits(few, tree)).count() == 3
    assert language_id.fit_limits(docs.limit(0), None) is None


def test_scores_do_not_depend_on_neighbours(spark):
    rows = helpers.corpus()[:40]
    table = helpers.documents(spark, rows)
    vectors = quality_classifier.word_vectors(table)

    def features(texts):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        return quality_classifier.pooled(vectors, np.frombuffer(b"".join(raw), np.uint8), offsets)

    texts = [t or "" for _, t in rows]
    assert np.allclose(features(texts), np.vstack([features([t]) for t in texts]), atol=1e-5)


def test_code_lengths_are_those_of_ppm(spark, monkeypatch):
    """The cost of every byte equals escape coding over counts kept in dictionaries."""
    rng = random.Random(8)
    texts = ["abracadabra " * 20, "cadabra abc " * 15,       # and more languages than are held at once
             *["".join(rng.choice("abcdr "[k % 4:] + "xyz"[k % 3]) for _ in range(300)) for k in range(17)]]
    table = spark.createDataFrame([(k, t, f"l{k:02d}") for k, t in enumerate(texts)],
                                  "doc_id bigint, text string, lang string")
    tree = language_id.fit_context_tree(table, min_count=8)
    counts = [collections.defaultdict(collections.Counter) for _ in texts]
    both = collections.Counter()
    for lang, text in enumerate(texts):
        padded = b"\0" * 3 + text.encode()
        for k in range(3, len(padded)):
            for order in range(4):
                counts[lang][padded[k - order:k]][padded[k]] += 1
                both[padded[k - order:k]] += 1

    known = set("".join(texts).encode())       # as contexts, other bytes are like a text's start

    def cost(lang, context, byte):
        own = counts[lang][context]
        total, distinct = sum(own.values()), len(own)
        shorter = 1 / 256 if not context else cost(lang, context[1:], byte)
        if not total:
            return shorter
        return own[byte] / (total + distinct) if own[byte] else distinct / (total + distinct) * shorter

    def bits(lang, text):
        padded, total = b"\0" * 3 + text, 0.0
        before = bytes(b if b in known else 0 for b in padded)
        for k in range(3, len(padded)):
            context = b""
            for order in (1, 2, 3):
                longer = before[k - order:k]
                if both[longer] < 8:
                    break
                context = longer
            total -= math.log2(cost(lang, context, padded[k]))
        return total

    samples = (b"abracadabra abc", b"cad", b"a", b"xyz \xc3\xa9 abc", b"")
    expected = [[bits(k, text) for k in range(len(texts))] for text in samples]
    data = np.frombuffer(b"".join(samples), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in samples])))
    for table_bytes in (language_id.TABLE_BYTES, 800):       # 800: tables are not kept, but made again
        monkeypatch.setattr(language_id, "TABLE_BYTES", table_bytes)
        codes = language_id.Codes(tree)
        for _ in range(2):
            assert np.allclose(language_id.code_lengths(codes, data, offsets), expected, rtol=1e-4)
        for text, row in zip(samples, expected):
            got = language_id.code_lengths(codes, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            assert np.allclose(got[0], row, rtol=1e-4)
    long_text = np.tile(np.frombuffer(samples[0], np.uint8), 150_000)         # more than one part
    codes = language_id.Codes(tree)
    whole = language_id.code_lengths(codes, long_text, np.array([0, len(long_text)]))
    cells = language_id._cells(tree, long_text, np.array([0, len(long_text)]))
    alone = [table[rows].sum(0, dtype=np.float64) for _, table, rows in codes.parts(cells)]
    assert np.allclose(whole[0], np.concatenate(alone))


def test_language_model_and_limits_are_learned_from_all_rows(spark, monkeypatch):
    """More rows than weigh in full, and more grams than a task holds or a part has: all are counted."""
    monkeypatch.setattr(language_id, "GRAMS_HELD", 50)
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 64)
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=20)) for _ in range(90)]
    rows = [(k % 80, t, "aa" if k < 85 else "bb") for k, t in enumerate(texts)]
    rows += [(None, "lorem ipsum", "bb"), (500, None, "aa"), (501, "sit", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tree = language_id.fit_context_tree(table, docs_per_language=4, min_count=2)
    counts = [collections.Counter(), collections.Counter()]
    for _, text, lang in rows:
        if text and lang:
            counts["ab".index(lang[0])].update(text.encode())
    size = tree.child.shape[1]
    root = tree.seen.rows(np.arange(size), 0, 2)
    for byte in set(counts[0] | counts[1]):
        assert [*root[tree.symbols[byte]]] == [counts[0][byte], counts[1][byte]]
    assert [*tree.mass.rows(np.array([0]), 0, 2)[0]] == [sum(c.values()) for c in counts]
    # contexts: an occurrence in aa weighs 4 / 85, in bb 4 / 6
    weighted = collections.Counter()
    for _, text, lang in rows:
        if text and lang:
            padded = b"\0" * 3 + text.encode()
            for k in range(3, len(padded)):
                for order in (1, 2, 3):
                    weighted[padded[k - order:k]] += 4 * 10**6 // (85 if lang == "aa" else 6)
    assert len(tree.child) == 1 + sum(n >= 2 * 10**6 for n in weighted.values())
    most = language_id.fit_context_tree(table, docs_per_language=4, min_count=2, max_nodes=20)
    assert len(most.child) == 20 and most.mass.rows(np.array([0]), 0, 2).sum() == sum(map(len, filter(
        None, (t for _, t, lang in rows if lang))))
    limits = language_id.fit_limits(table, tree, docs_per_language=4, min_count=2)
    assert np.isfinite(limits[0]).all() and np.isinf(limits[1]).all()      # too few of bb


def test_many_languages_are_all_learned(spark):
    """Three hundred languages, none dropped, in a model far under a dense table's size."""
    def made(k):
        rng = random.Random(k)
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 12)
        own = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(60)]
        return " ".join(rng.choices(own, k=1500)), " ".join(rng.choices(own, k=30))

    pairs = [made(k) for k in range(300)]
    docs = spark.createDataFrame([(k, a, f"l{k:03d}") for k, (a, _) in enumerate(pairs)],
                                 "doc_id bigint, text string, lang string")
    tree = language_id.fit_context_tree(docs)
    assert tree.languages == [f"l{k:03d}" for k in range(300)]
    size = len(pickle.dumps(tree))
    assert size < 100e6 and size < 0.25 * tree.child.size * 4 * 300
    short = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pairs)], "doc_id bigint, text string")
    got = language_id.score_languages(short, tree).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in got) >= 295


def test_pu_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    toxic = rng.random(4000) < 0.2
    x = (rng.random((4000, 30)) < 0.2).astype(np.float32)
    x[toxic, :3] = rng.random((toxic.sum(), 3)) < 0.7
    x[~toxic, :3] = 0
    known = toxic & (rng.random(4000) < 0.5)
    sample = np.vstack([x[known], x])
    positive = np.arange(len(sample)) < known.sum()
    w, b = toxicity.train_pu(sample, positive, 0.2, 0)
    scores = x @ w + b
    seen = toxic & (x[:, :3].sum(1) > 0)
    auc = np.mean(scores[seen][:, None] > scores[~toxic][None, :])
    assert auc > 0.98 and np.mean(scores[~toxic] < 0) > 0.97


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(3000) < p).astype(int)
    calibration = np.arange(3000) % 5 == 0
    net = quality_classifier.train_network(x, y, calibration)
    fresh = rng.normal(size=(5000, 5))
    q = 1 / (1 + np.exp(-(2 * fresh[:, 0] * fresh[:, 1] + fresh[:, 2])))
    assert np.mean(np.abs(net.probabilities(fresh) - q)) < 0.1
    flat = quality_classifier.train_network(x, np.ones(3000, int), calibration)
    assert flat.probabilities(x).min() > 0.9


# -- tokenizer -------------------------------------------------------------------------

PIECES = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control"),
          *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)],
          ("▁", -4.0, "normal"), ("a", -3.0, "normal"), ("b", -3.5, "normal"), ("ab", -4.0, "normal"),
          ("▁a", -2.0, "normal"), ("▁ab", -5.5, "normal"), ("ba", -3.0, "normal"), ("é", -2.0, "normal"),
          ("bab", -6.0, "normal"), ("▁▁", -9.0, "normal"), ("aé", -4.5, "normal")]


def encode(v, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, counts = unigram.encode_chunk(v, data, offsets)
    ends = np.cumsum(counts)
    assert [d.decode() for d in unigram.decode_chunk(v, ids, counts)] == texts
    return [ids[b - n:b].tolist() for b, n in zip(ends, counts)]


def best_score(v, text):
    """The highest sum over all splits, unknown characters included, by enumeration."""
    normal = {}
    for k, (piece, score, kind) in enumerate(PIECES):
        if kind == "normal":
            normal[piece] = score
    unknown = min(normal.values()) - 10

    def best(rest):
        if not rest:
            return 0.0
        options = [normal[rest[:n]] + best(rest[n:]) for n in range(1, len(rest) + 1)
                   if rest[:n] in normal]
        if rest[0] not in normal:
            options.append(unknown + best(rest[1:]))
        return max(options)

    return best("▁" + text.replace(" ", "▁")) if text else 0.0


def score_of(v, ids):
    """Score of ids in which a run of byte pieces of one character is one unknown."""
    out, raw = 0.0, b""
    for k in ids:
        if 2 <= k < 258:
            raw += bytes([k - 2])
            try:
                raw.decode()
            except UnicodeDecodeError:
                continue
            out, raw = out + v.unknown, b""
        else:
            out += PIECES[k][1]
    assert raw == b""
    return out


def test_encoding_is_the_best_split():
    v = unigram.build_vocabulary(PIECES)
    texts = ["".join(t) for n in range(0, 6) for t in itertools.product("ab é\n", repeat=n)]
    rng = random.Random(2)
    texts += ["".join(rng.choice("abé  z\n😀") for _ in range(rng.randrange(6, 14))) for _ in range(500)]
    for text, ids in zip(texts, encode(v, texts)):
        assert math.isclose(score_of(v, ids), best_score(v, text))


def test_units_in_step_equal_the_plain_search():
    v = unigram.read_vocabulary(VOCABULARY)
    rng = random.Random(4)
    texts = [t or "" for _, t in helpers.corpus()]
    texts += ["x" * 500 + " ok", "é" * 300 + "日本\n\n\n", " ", "  a  ", "\t\x00\x7f", "á 🙂🙃"]
    texts += ["".join(rng.choice("thein orsa,.-日é😀 ") for _ in range(200)) for _ in range(50)]
    for text, ids in zip(texts, encode(v, texts)):
        assert ids == (unigram.split_one(v, (" " + text).encode()) if text else [])


def test_long_units_equal_a_search_without_borders(monkeypatch):
    """Texts without spaces: cut at borders, they split as a plain search over all bytes does."""
    v = unigram.read_vocabulary(VOCABULARY)
    rng = random.Random(5)
    words = ["的", "中国", "是", "在", "我们", "人民", "经济", "，", "发展", "了", "上海"]
    texts = ["".join(rng.choice(words) for _ in range(600)),
             "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(1500)),
             "".join(chr(rng.randrange(0x4E00, 0x5500)) for _ in range(400)), "A" * 700, "=-" * 300,
             "héé日本" * 80 + "x" * 400 + " " * 300 + "\n" * 250 + "日" * 90]
    for walk in (unigram.WALK, 37):
        monkeypatch.setattr(unigram, "WALK", walk)
        for text, ids in zip(texts, encode(v, texts)):
            raw = (" " + text).encode()
            assert ids == helpers.plain_split(v, raw) == unigram.split_one(v, raw)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    cut = unigram.borders(v, data, np.array([0]), np.array([len(data)]))
    assert np.diff(cut).max() < unigram.LONG_UNIT


def test_double_array_holds_exactly_the_pieces():
    v = unigram.read_vocabulary(VOCABULARY)

    def look_up(raw):
        state = 0
        for b in raw:
            after = int(v.base[state]) + b
            if v.check[after] != state:
                return -1
            state = after
        return int(v.piece[state])

    byte_or_control = set(v.byte_ids.tolist()) | {0, 1, 2}
    for k, raw in enumerate(v.surface):
        if k not in byte_or_control:
            assert look_up(raw) == k
    assert look_up(b"zzzzqq") == -1 and look_up("ﷺﷺ".encode()) == -1


def test_token_columns(spark):
    v = unigram.read_vocabulary(VOCABULARY)
    rows = helpers.corpus() + [(3000, "marker ▁ read as a space")]
    df = helpers.documents(spark, rows).withColumnRenamed("source", "ids_sha256")
    coded = unigram.encode_texts(df, v)
    assert coded.columns == [*df.columns, "token_ids"]
    back = unigram.decode_tokens(coded, v).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.decoded == r.text and (r.token_ids is None) == (r.text is None)
        assert r.text is None or r.token_ids == (
            unigram.split_one(v, (" " + r.text).encode()) if r.text else [])
    digest = unigram.token_digests(df, v)
    assert digest.where("NOT round_trip").count() == 0 and digest.count() == len(rows)
    with pytest.raises(ValueError):
        unigram.encode_texts(coded, v)
    empty = spark.createDataFrame([], helpers.SCHEMA)
    assert unigram.encode_texts(empty, v).collect() == []
    assert unigram.token_digests(empty, v).collect() == []


def test_marker_characters_stay_in_the_texts(spark):
    rows = [(1, "bars ▁▂▃▁▁ end"), (2, "▁"), (3, "a ▁b▁ a"), (4, "ab a"), (5, None)]
    v = unigram.read_vocabulary(VOCABULARY)
    df = helpers.documents(spark, rows)
    back = unigram.decode_tokens(unigram.encode_texts(df, v), v).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.decoded for r in back} == dict(rows)
    assert unigram.token_digests(df, v).where("NOT round_trip").count() == 0
    bare = unigram.build_vocabulary([p for p in PIECES if p[2] != "byte"])
    got = {r.doc_id: r.round_trip for r in unigram.token_digests(df, bare).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True}


def test_sentencepiece_query_round_trips(spark):
    rows = QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.round_trip and r.n_tokens > 0 for r in rows)
