"""Scans and writers on files made for the test; the stream against the batch operator."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.sources import files as X
from orrery.sources import tables as S
from orrery.streaming.history import cochange_stream


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    shas = []
    for files in ({"a.py": "x\n", "lib/b.py": "y\n"}, {"a.py": "x2\n", "c.py": "é\n"}, {"lib/b.py": "y\n\n"}):
        for p, t in files.items():
            (root / p).parent.mkdir(exist_ok=True)
            (root / p).write_text(t)
        git("add", "-A")
        git("commit", "-qm", "step")
        shas.append(git("rev-parse", "HEAD"))
    (root / "bad.py").write_bytes(b"\xff\n")
    return str(root), shas


def test_git(spark, repo):
    root, shas = repo
    c = spark.createDataFrame([(root, s) for s in shas[:2]], "repo string, sha string")
    tree = X.git_tree(c)
    assert {(r.sha, r.path) for r in tree.collect()} == {(shas[0], "a.py"), (shas[0], "lib/b.py"), (shas[1], "a.py"), (shas[1], "lib/b.py"), (shas[1], "c.py")}
    texts = X.git_blobs(tree.union(spark.createDataFrame([(root, "x", "y", "0" * 40)], tree.schema)), at_once=2)
    got = {(r.sha, r.path): r.text for r in tree.join(texts, ["repo", "blob"]).collect()}
    assert got[shas[0], "a.py"] == "x\n" and got[shas[1], "a.py"] == "x2\n" and got[shas[1], "c.py"] == "é\n"
    log = {(r.base, r.sha, r.path) for r in X.git_log(spark.createDataFrame([(root, s) for s in shas], "repo string, base string")).collect()}
    first = {(shas[0], p) for p in ("a.py", "lib/b.py")}
    assert log == {(shas[1], *x) for x in first} | {(shas[2], *x) for x in first | {(shas[1], "a.py"), (shas[1], "c.py")}}


def test_trees_and_vectors(spark, repo, tmp_path):
    root, _ = repo
    got = {r.path: (r.text, r.bytes) for r in X.scan_tree(spark, root).collect()}
    assert got == {"a.py": ("x2\n", 3), "lib/b.py": ("y\n\n", 3), "c.py": ("é\n", 3), "bad.py": ("�\n", 2)}
    a = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.savez(tmp_path / "v.npz", one=a, other=np.zeros(3))
    rows = X.read_npz(spark, str(tmp_path / "v.npz")).orderBy("i").collect()
    assert [r.v for r in rows] == a.tolist() and {r.name for r in rows} == {"one"}


def test_writers_and_readers(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,b"), (2, None)], "k long, t string")
    for kind, back in (("parquet", spark.read.parquet), ("csv", lambda p: S.read_csv(spark, p, "k long, t string")), ("json", lambda p: S.read_jsonl(spark, p, "k long, t string")), ("jsonl.gz", lambda p: S.read_jsonl(spark, p, "k long, t string"))):
        p = str(tmp_path / kind)
        X.write(d, p, kind)
        assert sorted(map(tuple, back(p).collect())) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValueError):
        X.write(d, str(tmp_path / "no"), "xlsx")
    both = X.read_parquets(spark, [str(tmp_path / "parquet"), str(tmp_path / "parquet")])
    assert both.count() == 4
    p = str(tmp_path / "grow")
    assert [X.write_missing(d, p, ["k"]), X.write_missing(d, p, ["k"]), X.write_missing(d.union(spark.createDataFrame([(3, "c")], d.schema)), p, ["k"])] == [2, 0, 1]
    (tmp_path / "o.json").write_text('{"x": {"n": 1}, "y": {"n": 2}}')
    assert {(r.id, r.value.n) for r in S.read_json_object(spark, str(tmp_path / "o.json"), "struct<n:int>").collect()} == {("x", 1), ("y", 2)}
    S.write_new(d, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_stream_of_commits(spark, tmp_path):
    rows = [("c1", "2024-01-02 00:00:00", ["i", "j", "k"]), ("c2", "2024-01-03 00:00:00", ["i", "k", "k", None]), ("c3", "2024-01-04 00:00:00", ["l"]), ("c4", "2024-01-05 00:00:00", [])]
    d = spark.createDataFrame(rows, "sha string, t string, paths array<string>").select("sha", F.to_timestamp("t").alias("ts"), "paths")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = cochange_stream(stream).writeStream.outputMode("complete").format("memory").queryName("cochange_now").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seed, r.path): round(r.score, 9) for r in spark.table("cochange_now").collect()}
    flat = d.select(F.col("sha").alias("commit"), F.explode("paths").alias("path")).where("path IS NOT NULL")
    assert got == {(r.seed, r.path): round(r.score, 9) for r in G.cochange(flat).collect()} and len(got) == 6
