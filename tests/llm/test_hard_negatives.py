"""Hard negatives against all integer products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, x int, g string, block int"


def brute(rows, positives=5, negatives=3):
    """rows (vec_id, vector, label) as given; one of an id, the first by label, then integers."""
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        own[i] = min(own.get(i, (1 << 62, [])), (label, [math.floor(256 * c) for c in v]))
    out = set()
    for a, (label, x) in own.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in own.items() if i != a}
        best = sorted((i for i in score if own[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            fits = sorted((i for i in score if own[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:negatives]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits, 1)}
    return out


def got(frame):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_vectors(n, dim, seed, clusters=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    if clusters:
        v = r.normal(size=(clusters, dim))[r.integers(0, clusters, n)] + 0.3 * v
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.fixture
def written(spark, tmp_path):
    def put(rows):
        spark.createDataFrame([(*r, 1, "g", 3) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return put


def test_edge_rows(spark, written, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST", 40)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 64)
    r = random.Random(1)
    rows = [(i, list(map(float, v)), r.choice([0, 0, 0, 0, 1, 2, 9, -3])) for i, v in enumerate(some_vectors(700, 12, 2, 6))]
    rows += [(1000 + i, rows[i % 20][1], i % 3) for i in range(160)]
    rows += [(None, [1.0] * 12, 1), (2000, None, 1), (2050, [1.0] * 12, None), (2100, [math.nan] + [0.0] * 11, 1), (2150, [math.inf] + [0.0] * 11, 1), (2200, [None] + [0.0] * 11, 1)]
    rows += [(2250, [0.0] * 12, 0), (2300, [], 0), (2350, [0.5] * 5, 0), (2400, [-0.3] * 12, 55), (2450, [5.0] * 12, 1), (2451, [3.0] * 14, 1)]
    rows += [(50, rows[50][1], 4), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2])]
    want = brute(rows)
    assert len(want) > 100
    assert got(queries.op13_hard_negatives(spark, written(rows))) == want


def test_hot_label_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ASKED", 7)
    v = some_vectors(900, 16, 4)
    rows = [(i, list(map(float, v[i])), 3 if i % 3 else i) for i in range(900)]
    frame = spark.createDataFrame([(*r, 1, "g", 3) for r in rows], SCHEMA)
    d = frame.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert got(hard_negatives.hard_negatives(hard_negatives.integer_rows(d), "vec_id % 50 = 0", block=64)) == brute(rows)


def test_wide_components(spark):
    rows = [(i, [float(c) * 1e15 for c in v], i % 2) for i, v in enumerate(some_vectors(120, 3, 5).tolist())]
    frame = spark.createDataFrame([(*r, 1, "g", 3) for r in rows], SCHEMA)
    d = frame.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    ends = 2**63
    want = {r for r in brute(rows)}
    out = got(hard_negatives.hard_negatives(hard_negatives.integer_rows(d), "vec_id % 50 = 0"))
    # All products are beyond a long here: they are set to its ends, so nothing lies in a window.
    assert all(abs(r[4]) >= ends for r in want) and not out


def test_bounds_discard_and_keep():
    """Early discarding loses no pair that reaches its need, and takes few pairs to the integer product."""
    r = np.random.default_rng(6)
    x = np.floor(256 * some_vectors(3000, 64, 7, 40)).astype(np.int64)
    m = x.astype(float)
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    block = hard_negatives.Block(np.arange(3000), np.zeros(3000, np.int64), x, turn, False)
    a = x[r.integers(0, 3000, 60)]
    score = a @ block.x.T
    need = np.sort(score, axis=1)[:, -10].astype(float)
    counted = []
    real = block.exact
    block.exact = lambda *args: counted.append(len(args[1])) or real(*args)
    i, j, s = block.survivors(a, block.rotated(a), slice(0, 3000), need, np.ones((60, 3000), bool))
    assert set(zip(i, j)) == set(zip(*np.nonzero(score >= need[:, None]))) and (score[i, j] == s).all()
    assert counted[0] < 0.05 * score.size


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(hard_negatives.integer_rows(d), "vec_id % 50 = 0").count() == 0
