"""BM25, vector similarity and reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import dot
from orrery.staging import stage

#: Fixed values of the ranking formulas.
K1, B, RRF_K = 1.5, 0.75, 60


def bm25(tf: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(task, doc, score, found) for matching pairs: tf(doc, term, tf), docs(doc) all documents, terms(task, term) each once.

    N and the mean length are over all documents, empty ones included. Pairs that share no
    term are not listed; their score is 0. `found` counts the task's terms that a document has. Terms of no task may be
    counted together under null. Bags lie by document and weights, which are staged, come to them, so that matches of
    single terms are summed up where they are made.
    """
    by_doc = tf.repartition("doc")
    length = docs.select("doc").repartition("doc").join(by_doc.groupBy("doc").agg(F.sum("tf").alias("len")), "doc", "left").fillna(0, ["len"])
    stats = length.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = terms.distinct().join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = stage(w.select("task", "term", "idf", "avg_len"), "weights")
    hits = by_doc.join(length, "doc").join(w, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("task", "doc").agg(F.sum(part).alias("score"), F.count("*").alias("found"))


def bm25_files(tf: DataFrame, nodes: DataFrame, tasks: DataFrame, terms: DataFrame) -> DataFrame:
    """(task, path, score) for all files of a task's repository but its seed: tf(repo, path, term, tf), nodes(repo, path), tasks(task, repo, seed), terms(task, term) each once.

    A task's corpus is its own files, that is, without the seed: N, the mean length and
    document frequencies leave it out, empty files count. Files that share no term score 0;
    tasks without terms have no rows. What holds for a task is counted for its repository and then taken off for its
    seed; a task comes to the bags of its files with its weights, so rows of tasks and files are made where the bags lie.
    """
    length = tf.groupBy("repo", "path").agg(F.sum("tf").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("bag"))
    files = stage(nodes.select("repo", "path").join(length, ["repo", "path"], "left").select("repo", "path", F.coalesce("len", F.lit(0)).alias("len"), "bag"), "bags_of_files")
    size = files.groupBy("repo").agg(F.count("*").alias("n"), F.sum("len").alias("sum"))
    asked = tasks.select("task", "repo", "seed").join(terms.select("task").distinct(), "task", "left_semi")
    own = asked.join(files.withColumnRenamed("path", "seed"), ["repo", "seed"], "left").groupBy("task", "repo", "seed").agg(F.count("len").alias("own"), F.coalesce(F.sum("len"), F.lit(0)).alias("own_len"), F.first("bag").alias("own_bag"))
    stats = own.join(size, "repo").select("task", "repo", "seed", "own", "own_bag", (F.col("n") - F.col("own")).alias("n_docs"), F.try_divide((F.col("sum") - F.col("own_len")).cast("double"), F.col("n") - F.col("own")).alias("avg_len"))
    has = files.select("repo", F.explode(F.map_keys("bag")).alias("term")).groupBy("repo", "term").agg(F.count("*").alias("files"))
    df = F.coalesce("files", F.lit(0)) - F.when(F.coalesce(F.try_element_at("own_bag", "term"), F.lit(0)) > 0, F.col("own")).otherwise(0)
    weight = F.struct("term", F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5)).alias("idf"))
    w = stats.join(terms, "task").join(has, ["repo", "term"], "left").groupBy("task", "repo", "seed", "avg_len").agg(F.collect_list(weight).alias("weights"))
    x = files.join(F.broadcast(stage(w, "weights")), "repo").where("path <> seed")
    tf_of = lambda t: F.try_element_at("bag", t["term"])
    norm = K1 * (1 - B + B * F.try_divide("len", "avg_len"))
    part = lambda t: F.coalesce(t["idf"] * tf_of(t) * (K1 + 1) / (tf_of(t) + norm), F.lit(0.0))
    return x.select("task", "path", F.aggregate("weights", F.lit(0.0), lambda a, t: a + part(t)).alias("score"))


def rrf(*orders: DataFrame, k: int = RRF_K) -> DataFrame:
    """(task, doc, score): sum of 1 / (k + pos) over orderings(task, doc, pos)."""
    rows = reduce(DataFrame.unionByName, [o.select("task", "doc", "pos") for o in orders])
    return rows.groupBy("task", "doc").agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"))


#: Queries that are broadcast at a time.
BLOCK = 1024


def against_all(queries: DataFrame, docs: DataFrame, key: str = "task") -> DataFrame:
    """Each row of docs beside each row of a stated query set, in blocks of at most BLOCK queries, so that no broadcast grows."""
    n = queries.count()
    if n <= BLOCK:
        return docs.crossJoin(F.broadcast(queries))
    blocks = -(-2 * n // BLOCK)
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [docs.crossJoin(F.broadcast(queries.where(part == b))) for b in range(blocks)])


def cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(task, doc, score): inner products of unit vectors, a stated query set against all rows; a missing vector scores -2."""
    pairs = against_all(queries, docs)
    return pairs.select("task", "doc", F.coalesce(dot(F.col("q"), F.col("v")), F.lit(-2.0)).alias("score"))


def mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(key, v): the mean of vectors v weighed by w, scaled to length 1; components are summed apart, so no group is gathered."""
    x = rows.select(key, "w", F.posexplode("v").alias("i", "x"))
    m = x.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    whole = m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return whole.select(key, F.transform("v", lambda e: F.try_divide(e, F.col("norm"))).alias("v"))
