"""Toxicity: the index against all cosines, held-out accuracy, edge rows."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import queries, toxicity

DOCS = "doc_id long, text string, h long, y double, lang string, source string, toxic int"
LABELS = "doc_id long, quality int, toxic int, text string"
BAD = ["grolm", "fendix", "spaggle"]


def prose(r, n):
    return [r.choice(["ta", "ne", "lo", "mi", "su"]) + r.choice(["ra", "pel", "dor", "vin", "ket", "os"]) + r.choice(["", "", "a", "en", "is"]) for _ in range(n)]


def made(n=900, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w, toxic = prose(r, r.choice([5, 30, 80, 300])), r.random() < 0.2
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 5, 0.5, "en", "x", 9) for i, t in docs], DOCS).repartition(3)
    return d, spark.createDataFrame([(i, 1, None if y is None else int(y), "z") for i, y in labels], LABELS)


def test_index_finds_the_nearest_exactly(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    docs, labels = made(400)
    index = toxicity._lists(toxicity.examples(*frames(spark, docs, labels), "doc_id", "text", "toxic", 300, 10**9), 8, 0.5)
    assert index.n == 300 and index.n_blocks == 38
    dense = np.zeros((index.n, index.n_words))
    key = np.repeat(np.arange(index.n_blocks * index.n_words), np.diff(index.start.astype(int)))
    dense[index.at, key % index.n_words] = index.weight
    assert np.allclose([(dense[i] ** 2).sum() for i in range(index.n) if dense[i].any()], 1)
    text = dict(docs)
    for i in range(0, 400, 7):
        terms, w = index.vector(toxicity.bag(text[i]))
        q = np.zeros(index.n_words)
        q[terms] = w
        all_of = dense @ q
        best, score = index.nearest(terms, w, 10)
        want = sorted(all_of[all_of > 1e-12], reverse=True)[:10]
        assert np.allclose(score, want) and np.allclose(all_of[best], score) and len(set(best)) == len(best)
        if i in set(index.ids):
            own = int(np.flatnonzero(index.ids == i)[0])
            assert own not in index.nearest(terms, w, 10, without=own)[0]


def test_weights_are_tf_idf(spark):
    docs, labels = [(i, "kato " * (1 + i % 3) + ("grolm" if i % 4 == 0 else "vinos")) for i in range(40)], [(i, i % 4 == 0) for i in range(40)]
    index = toxicity._lists(toxicity.examples(*frames(spark, docs, labels), "doc_id", "text", "toxic", 100, 10**9), 1, 1)
    # Copies of a text are one example: 3 toxic and 3 clean texts are left.
    assert index.n == 6 and sorted(index.labels) == [0, 0, 0, 1, 1, 1]
    idf = {w: index.idf[i] for w, i in index.words.items()}
    assert idf == pytest.approx({"grolm": math.log(4) ** 1.5, "kato": 0.0, "vinos": 0.0})


def test_held_out_accuracy(spark):
    docs, labels = made()
    d, lab = frames(spark, docs, labels[:600])
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, lab, evidence=False).collect()}
    truth = dict(labels)
    rest = range(600, 900)
    hit = np.mean([got[i] >= 0.5 for i in rest if truth[i]])
    false = np.mean([got[i] >= 0.5 for i in rest if not truth[i]])
    assert hit >= 0.95 and false <= 0.02, (hit, false)
    # Calibration: the scores sum to about as many as there are.
    assert abs(sum(got[i] for i in rest) - sum(truth[i] for i in rest)) < 15


def test_edge_rows(spark):
    docs, labels = made(300)
    docs += [(1000, None), (1001, ""), (1002, " \n12 %%"), (1003, "grolm"), (1004, "grolm"), (None, "grolm"), (1005, "GROLM! fendix, spaggle"), (1006, "x" * 3_000_000), (1007, ("tara " * 700_000) + "grolm"), (1, docs[1][1]), (2, "other text")]
    labels += [(None, True), (5, None), (4, True), (4, False), (99_999, True), (1000, False)]
    rows = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    assert len(rows) == len(docs)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    s = lambda i: got[i][0].score
    assert s(1000) == s(1001) == s(1002) and not got[1000][0].neighbours
    assert s(1003) == s(1004) == s(None) and s(1003) > 0.5 and s(1005) > 0.5
    assert len(got[1]) == 2 and got[1][0].score == got[1][1].score
    n = got[1003][0].neighbours
    assert n[0].toxic == 1 and all(a.cosine >= b.cosine for a, b in zip(n, n[1:]))
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_examples_and_bounds(spark):
    docs, labels = made(60)
    d, lab = frames(spark, docs, labels)
    assert {r.score for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
    sized = toxicity.examples(d, lab, "doc_id", "text", "toxic", 20, 3000).collect()
    assert 0 < len(sized) < 20 and sum(len(r.text) for r in sized) <= 3000
    assert {r.score for r in toxicity.toxicity(d, lab.where("toxic = 0")).collect() if r.score >= 0.5} == set()


def test_words_of_long_texts_are_whole(monkeypatch):
    r = random.Random(4)
    text = " ".join(prose(r, 3000)) + "." + "q" * 500
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "PIECE", 97)
    assert toxicity.bag(text) == whole and whole["q" * 500] == whole["qqqqqq~"] == 1


def test_query_on_given_rows(spark):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").select("score", F.col("toxic")).collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.7
