"""Reading-order operators on hand-made tables, and every query against its SQL on the smallest tables."""

import glob
import itertools
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import graph as G
from orrery.operators import retrieval, scoring, stats
from orrery.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [("k", "m"), ("k", "p"), ("m", "q"), ("q", "w"), ("w", "m"), ("x", "k"), ("x", "q")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


@pytest.fixture(scope="module")
def seed(spark):
    return spark.createDataFrame([("t", "k")], "task string, node string")


def test_split_ident(spark):
    want = {"load_XMLFile": ["load", "xml", "file"], "isOk": ["is", "ok"], "lastUserItem": ["last", "user", "item"], "__init__": ["init"], "HTTP2Server": ["http", "server"], "x": [], "_": [], "Plain": ["plain"], "a1": ["a1"]}
    d = spark.createDataFrame([(k,) for k in want], "x string")
    got = {r.x: r.t for r in d.select("x", T.split_ident(F.col("x")).alias("t")).collect()}
    plain = lambda n: [t.lower() for p in n.split("_") for t in re.findall("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", p) if len(t) > 1]
    assert got == {k: plain(k) for k in want} and got["load_XMLFile"] == want["load_XMLFile"] and got["lastUserItem"] == want["lastUserItem"]
    text = "load_XMLFile(isOk, isOk) 9x _x Plain plain"
    bag = {r.term: r.tf for r in T.text_bag(spark.createDataFrame([(1, text), (2, None)], "doc long, text string"), "doc", F.col("text")).collect()}
    assert bag == dict(Counter(t for n in re.findall("[A-Za-z_][A-Za-z0-9_]*", text) for t in plain(n)))


def test_paths(spark):
    d = spark.createDataFrame([("a/b/c.py", "a/d/e.py", 4), ("x.py", "y.py", 0), ("tests/x.py", "pkg/e.py", 2)], "a string, b string, n int")
    for r in d.select(T.folder_distance(F.col("a"), F.col("b")).alias("d"), T.is_test_path(F.col("a")).alias("t"), "a").collect():
        assert (r.d, r.t) == {"a/b/c.py": (2, False), "x.py": (0, False), "tests/x.py": (2, True)}[r.a]


def test_levels(spark, edges, seed):
    level = lambda e, d=9: {r.node: r.dist for r in G.bfs(e, seed, d).collect()}
    assert level(edges) == {"k": 0, "m": 1, "p": 1, "q": 2, "w": 3} and level(G.reverse(edges)) == {"k": 0, "x": 1}
    assert level(G.undirected(edges), 1) == {"k": 0, "m": 1, "p": 1, "x": 1}


def test_cochange(spark):
    commits = {"v1": "ijk", "v2": "ik", "v3": "ijkl", "v4": "l", "v5": "lj"}
    got = {(r.seed, r.path): r.score for r in G.cochange(spark.createDataFrame([(c, p) for c, ps in commits.items() for p in ps], "commit string, path string")).collect()}
    want = Counter()
    for ps in commits.values():
        for a, b in itertools.permutations(ps, 2):
            want[a, b] += 1 / (len(ps) - 1)
    assert got == pytest.approx(dict(want))


def test_reference_graph(spark):
    defs = [("m1", "Loader"), ("m1", "scan"), ("m2", "Sink"), ("m3", "common"), ("m4", "common"), ("m5", "common"), ("m6", "common"), ("m7", "common"), ("m8", "common")]
    refs = [("m2", "Loader"), ("m2", "scan"), ("m3", "Sink"), ("m2", "Sink"), ("m1", "common"), ("m9", "scan"), ("m9", "scan")]
    got = {(r.src, r.dst): r.weight for r in G.reference_graph(spark.createDataFrame(defs, "file string, name string"), spark.createDataFrame(refs, "file string, name string")).collect()}
    few = {n for n, c in Counter(n for _, n in defs).items() if c <= 5}
    assert got == dict(Counter((a, b) for a, n in set(refs) for b, m in defs if n == m and n in few and a != b))


def test_pagerank_keeps_mass(spark, edges, seed):
    names = "kmpqwx"
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    got = {r.node: r.score for r in G.pagerank(nodes, edges, seed.withColumn("p", F.lit(1.0)), 20).collect()}
    assert sum(got.values()) == pytest.approx(1) and "x" not in got
    m, own = np.zeros((6, 6)), np.eye(6)[0]
    at = {n: i for i, n in enumerate(names)}
    for a, b in EDGES:
        m[at[b], at[a]] = 1 / sum(x == a for x, _ in EDGES)
    m[:, at["p"]] = own  # p leads nowhere: its mass goes back to the seed
    x = own
    for _ in range(20):
        x = 0.85 * (m @ x) + 0.15 * own
    assert [got.get(n, 0) for n in names] == pytest.approx(x.tolist())


def test_bm25_and_fusion(spark):
    tf = spark.createDataFrame([("x", "p", 3), ("x", "q", 2), ("y", "p", 1)], "doc string, term string, tf int")
    docs = spark.createDataFrame([("x",), ("y",), ("z",)], "doc string")
    got = {r.doc: r.score for r in retrieval.bm25(tf, docs, spark.createDataFrame([(1, "p"), (1, "p"), (1, "none")], "task int, term string")).collect()}
    idf, avg = math.log(1 + 1.5 / 2.5), 2.0
    assert got == pytest.approx({"x": idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 5 / avg)), "y": idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avg))})
    order = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "task int, doc string, pos int")
    assert {r.doc: r.score for r in retrieval.rrf(order, order.where("pos = 2")).collect()} == pytest.approx({"x": 1 / 61, "y": 2 / 62})


def test_scoring_example(spark):
    rows = [("t", "m", i + 1, c, k, 2) for i, (c, k) in enumerate([(100, 0), (200, 1), (300, 0), (250, 1)])]
    o = spark.createDataFrame(rows, "task string, method string, pos int, cost int, in_key int, key_size int")
    curve = lambda d: [r.coverage for r in d.orderBy("budget").collect()]
    assert curve(scoring.coverage(o)) == [0, 0.5] + [1] * 6 and scoring.auc(scoring.coverage(o)).first().auc == 0.8125
    assert curve(scoring.coverage_skip(o)) == [0, 0.5] + [1] * 6 and curve(scoring.coverage_files(o)) == [0, 0.5] + [1] * 6
    r = scoring.lines_to_reach(o).first()
    assert (r.lines_half, r.lines_all) == (300, 850)


def test_statistics(spark):
    t = spark.createDataFrame([(1, 0.01, "a"), (1, 0.04, "b"), (1, 0.03, "c")], "f int, p double, id string")
    assert {r.id: r.p_holm for r in stats.holm(t, ["f"]).collect()} == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    assert stats.signed_rank_p(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(2 / 32)
    assert stats.signed_rank_p(np.zeros(4)) == 1.0
    n, mean = np.full(4, 5.0), np.array([1.0, 2, 3, 6])
    mu, se = stats.random_intercept(n, n * mean, n * mean**2 + 4)
    assert mu == pytest.approx(3.0) and se == pytest.approx(math.sqrt(mean.var(ddof=1) / 4), rel=1e-2)


def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda v: "null" if v is None or v is __import__("pandas").NA or v != v else f"{float(v):.5f}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(clean, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert rows_of(got) == rows_of(con.execute(ORACLE_SQL[name]).fetchdf())


def test_signed_ranks_by_all_signs():
    """The exact p against all ways to set the signs; the normal one near it."""
    r = np.random.default_rng(3)
    for n in (3, 6, 9):
        d = r.normal(size=n) + 0.4
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        w = [ranks[np.array(s) > 0].sum() for s in itertools.product([1, -1], repeat=n)]
        low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
        assert stats.signed_rank_p(d) == pytest.approx(min(1, 2 * np.mean([x <= low for x in w])))
    d = np.round(r.normal(size=60) + 0.2, 1)
    assert 0 < stats.signed_rank_p(d) < 1 and stats.signed_rank_p(d) == stats.signed_rank_p(-d)


def test_resampled_interval(spark):
    """Near the normal interval of a mean of equal groups; the same twice."""
    r = np.random.default_rng(5)
    rows = [("m", i, float(x), 1) for i, x in enumerate(r.normal(2, 1, 200))]
    g = spark.createDataFrame(rows, "method string, unit int, s double, n int")
    lo, hi = (stats.bootstrap_ci(g, ["method"], resamples=800).first()[c] for c in ("lo", "hi"))
    x = np.array([v for _, _, v, _ in rows])
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert lo == pytest.approx(x.mean() - half, abs=0.05) and hi == pytest.approx(x.mean() + half, abs=0.05)
    assert stats.bootstrap_ci(g, ["method"], resamples=800).first().lo == lo
