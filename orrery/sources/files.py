"""Scans of files, archives of vectors and git repositories, and writers; everything comes in as tables.

Git is asked on executors, one repository and commit a row, so repositories must lie where all
machines see them. Texts that are no UTF-8 are read with replacement characters.
"""

from __future__ import annotations

import io
import subprocess
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read_parquets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet tables one after the other; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


@F.pandas_udf(StringType())
def _text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "replace"))


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, text, bytes) of the files below a folder whose names fit; paths are from the folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    inner = F.expr("substring(_full, length(_top) + 2)")
    d = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("_full"), top.alias("_top"), F.col("content"), F.col("length").alias("bytes"))
    d = d.select(inner.alias("path"), _text(F.col("content")).alias("text"), "bytes")
    return d.where(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, i, v): the rows of every two-dimensional array in .npz files; a file is read by one task, its arrays one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                with np.load(io.BytesIO(content)) as arrays:
                    for name in arrays.files:
                        a = arrays[name]
                        if a.ndim == 2:
                            for s in range(0, len(a), 4096):
                                part = a[s : s + 4096].astype(np.float32)
                                yield pd.DataFrame({"file": file, "name": name, "i": np.arange(s, s + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, name string, i long, v array<float>")


def _git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, check=True).stdout


def git_tree(commits: DataFrame) -> DataFrame:
    """(repo, sha, path, blob) of the files of commits(repo, sha); repo is the repository's folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, sha in zip(batch.repo, batch.sha, strict=True):
                rows = [e.split(b"\t", 1) for e in _git(repo, "ls-tree", "-r", "-z", sha).split(b"\0") if e]
                own = [(repo, sha, path.decode("utf-8", "replace"), head.split()[2].decode()) for head, path in rows if head.split()[1] == b"blob"]
                yield pd.DataFrame(own, columns=["repo", "sha", "path", "blob"])

    return commits.select("repo", "sha").distinct().mapInPandas(run, "repo string, sha string, path string, blob string")


def git_blobs(blobs: DataFrame, at_once: int = 200) -> DataFrame:
    """(repo, blob, text) of blobs(repo, blob), each once; `at_once` of them are asked for in one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, own in batch.groupby("repo"):
                names = own.blob.tolist()
                for s in range(0, len(names), at_once):
                    out = io.BytesIO(_git(repo, "cat-file", "--batch", stdin="\n".join(names[s : s + at_once]).encode() + b"\n"))
                    rows = []
                    while head := out.readline().split():
                        if head[1] != b"missing":
                            rows.append((repo, head[0].decode(), out.read(int(head[2])).decode("utf-8", "replace")))
                            out.read(1)
                    yield pd.DataFrame(rows, columns=["repo", "blob", "text"])

    return blobs.select("repo", "blob").distinct().mapInPandas(run, "repo string, blob string, text string")


def git_log(bases: DataFrame) -> DataFrame:
    """(repo, base, sha, ts, path): files of the commits strictly before bases(repo, base), along first parents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, base in zip(batch.repo, batch.base, strict=True):
                rows = []
                log = _git(repo, "log", "--first-parent", "-m", "--name-only", "--no-renames", "--format=%x01%H %ct", f"{base}^") if _has_parent(repo, base) else b""
                for entry in log.decode("utf-8", "replace").split("\x01")[1:]:
                    head, *paths = entry.strip().splitlines()
                    sha, ts = head.split()
                    rows += [(repo, base, sha, int(ts), p) for p in paths if p]
                yield pd.DataFrame(rows, columns=["repo", "base", "sha", "ts", "path"])

    return bases.select("repo", "base").distinct().mapInPandas(run, "repo string, base string, sha string, ts long, path string")


def _has_parent(repo: str, sha: str) -> bool:
    return len(_git(repo, "rev-list", "--parents", "-n", "1", sha).split()) > 1


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Parquet, csv (with a head), json lines, or json lines in gzip."""
    w = df.write.mode(mode)
    match kind:
        case "parquet":
            w.parquet(path)
        case "csv":
            w.csv(path, header=True)
        case "json":
            w.json(path)
        case "jsonl.gz":
            w.json(path, compression="gzip")
        case _:
            raise ValueError(f"unknown kind {kind!r}")


def write_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table at `path` does not hold yet, so that a run can be taken up again; returns how many."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    before = spark.read.parquet(path).count() if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath) else 0
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
