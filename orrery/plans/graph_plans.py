"""Queries on graphs and histories over part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import graph as G
from orrery.operators import ranks as R
from orrery.sources import tables as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Levels that the SQL of searches goes at most, far more than there are; the queries go on until nothing new is reached.
DEPTH = 16

_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
FROM lineitem) WHERE dst IS NOT NULL AND src <> dst), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), rv AS (SELECT dst AS src, src AS dst FROM e),
seeds AS (SELECT p_brand AS task, min(p_partkey) AS node FROM part GROUP BY p_brand)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _bfs_cte(edges: str, depth: int) -> str:
    return f"""r AS (SELECT task, node, 0 AS dist FROM seeds UNION SELECT r.task, {edges}.dst, r.dist + 1 FROM r JOIN {edges} ON {edges}.src = r.node WHERE r.dist < {depth}),
b AS (SELECT task, node, min(dist) AS dist FROM r GROUP BY ALL)"""


def _bfs(edges, depth: int | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.bfs(edges(S.graph_edges(spark, d)), S.seeds(spark, d), depth).where("dist > 0")

    return run


for _name, _f, _sql, _depth in (("bfs_fwd", lambda e: e, "e", None), ("bfs_rev", G.reverse, "rv", None), ("bfs_und", G.undirected, "u", None), ("khop1", G.undirected, "u", 1), ("khop2", G.undirected, "u", 2)):
    QUERIES[_name] = _bfs(_f, _depth)
    ORACLE_SQL[_name] = f"WITH RECURSIVE {_EDGES}, {_bfs_cte(_sql, _depth or DEPTH)} SELECT * FROM b WHERE dist > 0"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs(G.undirected(S.graph_edges(spark, d)), S.seeds(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, {_bfs_cte('u', DEPTH)} SELECT task, node, row_number() OVER (PARTITION BY task ORDER BY dist, p_size, node) AS pos
FROM b JOIN part ON p_partkey = node WHERE dist > 0""")
def hops_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _levels(spark, d).where("dist > 0").join(S.graph_nodes(spark, d), "node")
    return G.ordered(rows, [F.col("dist"), F.col("cost"), F.col("node")]).select("task", "node", "pos")


@query(f"WITH {_EDGES} SELECT p_partkey AS node, count(e.src) AS score FROM part LEFT JOIN e ON e.dst = p_partkey GROUP BY ALL")
def indegree(spark: SparkSession, d: str) -> DataFrame:
    n = S.graph_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("score"))
    return S.graph_nodes(spark, d).select("node").join(n, "node", "left").fillna(0, ["score"])


def _rank_sql(edges: str, start: str) -> str:
    """The iteration of ranks.ranked with its stop for each task: x holds all rounds, last the end of each task."""
    go = f"(i % {R.BLOCK} <> 0 OR err >= tol) AND i < {R.ROUNDS}"
    return f"""WITH RECURSIVE {_EDGES}, dg AS MATERIALIZED (SELECT src, count(*) AS deg FROM {edges} GROUP BY src), st AS MATERIALIZED ({start}), least AS (SELECT count(*) * 1e-6 AS tol FROM part),
x AS (SELECT 0 AS i, task, p_partkey AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY task) AS score, 1e9::DOUBLE AS err, 1.0::DOUBLE AS tol FROM part, (SELECT DISTINCT task FROM st) UNION ALL
SELECT i, y.task, node, score, sum(abs(score - was)) OVER (PARTITION BY y.task) AS err, least.tol FROM least, (
  SELECT max(i) AS i, task, node, sum(score) AS score, sum(was) AS was FROM (
    SELECT x.i + 1 AS i, x.task, dst AS node, 0.85::DOUBLE * score / deg AS score, 0.0::DOUBLE AS was FROM x JOIN {edges} ON {edges}.src = x.node JOIN dg ON dg.src = x.node WHERE {go}
    UNION ALL SELECT l.i + 1, st.task, st.node, p * (0.15::DOUBLE + 0.85::DOUBLE * lost), 0.0 FROM st JOIN (SELECT i, task, sum(CASE WHEN dg.src IS NULL THEN score ELSE 0 END) AS lost FROM x LEFT JOIN dg ON dg.src = x.node WHERE {go} GROUP BY i, task) l ON l.task = st.task
    UNION ALL SELECT i + 1, task, node, 0.0, score FROM x WHERE {go}) GROUP BY task, node) y),
last AS (SELECT task, node, arg_max(score, i) AS score FROM x GROUP BY task, node)"""


_SEED = "SELECT task, node, 1.0::DOUBLE AS p FROM seeds"
_ALL = "SELECT 'all' AS task, p_partkey AS node, 1.0::DOUBLE / count(*) OVER () AS p FROM part"


def _ranked(spark: SparkSession, d: str, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, node, score) of tasks(task, node) on the one large graph."""
    whole = F.lit("all").alias("repo")
    r = R.ranked(S.graph_nodes(spark, d).select(whole, "node"), edges.select(whole, "src", "dst", F.lit(1.0).alias("weight")), tasks.select(whole, "task", F.col("node").alias("seed")))
    return r.select("task", "node", F.round("score", 9).alias("score"))


def _ppr(edges):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _ranked(spark, d, edges(S.graph_edges(spark, d)), S.seeds(spark, d))

    return run


for _name, _f, _sql in (("ppr_und", G.undirected, "u"), ("ppr_out", lambda e: e, "e"), ("ppr_in", G.reverse, "rv")):
    QUERIES[_name] = _ppr(_f)
    ORACLE_SQL[_name] = f"{_rank_sql(_sql, _SEED)} SELECT task, node, round(score, 9) AS score FROM last"


@query(f"{_rank_sql('u', _SEED)} SELECT task, node, round(round(score, 9) / greatest(p_size, 1), 9) AS score FROM last JOIN part ON p_partkey = node")
def ppr_und_pl(spark: SparkSession, d: str) -> DataFrame:
    rows = QUERIES["ppr_und"](spark, d).join(S.graph_nodes(spark, d), "node")
    return rows.select("task", "node", F.round(F.col("score") / F.greatest("cost", F.lit(1)), 9).alias("score"))


@query(f"{_rank_sql('e', _ALL)} SELECT node, round(score, 9) AS score FROM last")
def pagerank_fixed(spark: SparkSession, d: str) -> DataFrame:
    task = spark.createDataFrame([("all", None)], f"task string, node {S.graph_nodes(spark, d).schema['node'].dataType.simpleString()}")
    return _ranked(spark, d, S.graph_edges(spark, d), task).select("node", "score")


def _hits_sql() -> str:
    return f"""WITH RECURSIVE {_EDGES}, x AS (SELECT 0 AS i, p_partkey AS node, 1.0::DOUBLE / count(*) OVER () AS h, 0.0::DOUBLE AS a, TRUE AS go FROM part UNION ALL
SELECT i, node, h, a, i % {G.HITS_BLOCK} <> 0 OR sum(abs(h - old)) OVER () >= 1e-8 AS go FROM (
  SELECT i, node, rh / sum(rh) OVER () AS h, a, old FROM (
    SELECT n.i, n.node, coalesce(sum(b.a), 0) AS rh, any_value(n.a) AS a, any_value(n.old) AS old FROM (
      SELECT i, node, ra / sum(ra) OVER () AS a, old FROM (SELECT x.i + 1 AS i, x.node, coalesce(sum(y.h), 0) AS ra, any_value(x.h) AS old FROM x LEFT JOIN e ON e.dst = x.node LEFT JOIN x y ON y.node = e.src WHERE x.go GROUP BY x.i, x.node)) n
    LEFT JOIN e ON e.src = n.node LEFT JOIN (SELECT node, ra / sum(ra) OVER () AS a FROM (SELECT x.node, coalesce(sum(y.h), 0) AS ra FROM x LEFT JOIN e ON e.dst = x.node LEFT JOIN x y ON y.node = e.src WHERE x.go GROUP BY x.node)) b ON b.node = e.dst GROUP BY n.i, n.node)))
SELECT node, round(a, 9) AS score FROM x WHERE i = (SELECT max(i) FROM x)"""


@query(_hits_sql())
def hits_fixed(spark: SparkSession, d: str) -> DataFrame:
    return G.hits_authority(S.graph_nodes(spark, d), S.graph_edges(spark, d)).withColumn("score", F.round("score", 9))


_COMMITS = "c AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS path FROM lineitem), n AS (SELECT commit, count(*) AS n FROM c GROUP BY ALL)"
_CO = f"{_COMMITS}, co AS (SELECT a.path AS seed, b.path, round(sum(1.0::DOUBLE / (n - 1)), 6) AS score FROM c a JOIN n USING (commit) JOIN c b USING (commit) WHERE a.path <> b.path AND n BETWEEN 2 AND 50 GROUP BY ALL)"


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))


@query(f"WITH {_CO} SELECT * FROM co")
def cochange(spark: SparkSession, d: str) -> DataFrame:
    return G.cochange(_commits(spark, d)).withColumn("score", F.round("score", 6))


_NAMES = "l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line FROM documents), defs AS (SELECT DISTINCT file, regexp_extract(line, '[A-Za-z_][A-Za-z0-9_]*') AS name FROM l WHERE regexp_matches(line, '[A-Za-z_]')), refs AS (SELECT DISTINCT doc_id AS file, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)"


@query(f"""WITH {_NAMES}, few AS (SELECT name FROM defs GROUP BY name HAVING count(*) <= 5)
SELECT r.file AS src, d.file AS dst, count(*) AS weight FROM refs r JOIN defs d USING (name) WHERE name IN (SELECT name FROM few) AND r.file <> d.file GROUP BY ALL""")
def refgraph(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of a document refer to documents in which a line begins with them."""
    t = S.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    defs = t.select("file", F.explode(F.split("text", "\n")).alias("line")).select("file", F.regexp_extract("line", T.IDENTIFIER, 0).alias("name")).where("name <> ''")
    refs = t.select("file", F.explode(F.regexp_extract_all("text", F.lit(T.IDENTIFIER), F.lit(0))).alias("name"))
    return G.reference_graph(defs, refs)


# Answer keys: parts of the seed's kind ('symbol') and parts ordered with it ('co_edited').
_KEYS = f"""{_COMMITS}, keys AS (SELECT 'symbol' AS source, task, q.p_partkey AS node FROM seeds JOIN part p ON p.p_partkey = seeds.node JOIN part q ON q.p_type = p.p_type AND q.p_partkey <> p.p_partkey
UNION ALL SELECT DISTINCT 'co_edited', task, b.path FROM seeds JOIN c a ON a.path = seeds.node JOIN c b ON a.commit = b.commit WHERE b.path <> a.path)"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    n, s = S.graph_nodes(spark, d), S.seeds(spark, d)
    kind = s.join(n, "node").select("task", "kind", F.col("node").alias("seed"))
    symbol = kind.join(n, "kind").where("node <> seed").select(F.lit("symbol").alias("source"), "task", "node")
    c = _commits(spark, d).distinct()
    edited = s.withColumnRenamed("node", "path").join(c, "path").select("task", "commit", F.col("path").alias("seed")).join(c, "commit").where("path <> seed")
    return symbol.union(edited.select(F.lit("co_edited").alias("source"), "task", F.col("path").alias("node")).distinct())


_DIST = f"WITH RECURSIVE {_EDGES}, {_bfs_cte('u', DEPTH)}, {_KEYS}, kd AS (SELECT keys.*, dist FROM keys LEFT JOIN b USING (task, node))"


def _key_dist(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).join(_levels(spark, d), ["task", "node"], "left")


@query(f"{_DIST} SELECT source, task, node, CAST(dist AS DOUBLE) AS dist FROM kd")
def distances(spark: SparkSession, d: str) -> DataFrame:
    return _key_dist(spark, d).select("source", "task", "node", F.col("dist").cast("double").alias("dist"))


@query(f"""{_DIST}, h AS (SELECT source, CASE WHEN dist IS NULL THEN 'unreachable' WHEN dist >= 3 THEN '3+' ELSE dist::VARCHAR END AS bucket, count(*) AS n FROM kd GROUP BY ALL)
SELECT source, bucket, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM h""")
def distance_profile(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    bucket = F.when(F.col("dist").isNull(), "unreachable").when(F.col("dist") >= 3, "3+").otherwise(F.col("dist").cast("string"))
    h = _key_dist(spark, d).groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return h.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(f"""WITH RECURSIVE {_EDGES}, {_bfs_cte('u', 2)}, {_KEYS}, un AS (SELECT DISTINCT task, node FROM keys),
s AS (SELECT task, count(*) AS ball_files, sum(p_size) AS ball_lines, count(un.node) AS found FROM b JOIN part ON p_partkey = b.node LEFT JOIN un USING (task, node) WHERE dist > 0 GROUP BY ALL),
k AS (SELECT task, count(*) AS key_files FROM un GROUP BY ALL)
SELECT task, ball_files, CAST(ball_lines AS BIGINT) AS ball_lines, key_files, round(found / key_files, 6) AS recall, round(found / ball_files, 6) AS precision,
round(ball_files / greatest((SELECT count(*) FROM part) - 1, 1), 6) AS share FROM s JOIN k USING (task)""")
def ball(spark: SparkSession, d: str) -> DataFrame:
    n = S.graph_nodes(spark, d)
    key = _keys(spark, d).select("task", "node").distinct()
    near = G.bfs(G.undirected(S.graph_edges(spark, d)), S.seeds(spark, d), 2).where("dist > 0").join(n, "node")
    s = near.join(key.withColumn("hit", F.lit(1)), ["task", "node"], "left").groupBy("task").agg(F.count("*").alias("ball_files"), F.sum("cost").alias("ball_lines"), F.count("hit").alias("found"))
    all_files = F.broadcast(n.agg(F.count("*").alias("files")))
    s = s.join(key.groupBy("task").agg(F.count("*").alias("key_files")), "task").crossJoin(all_files)
    return s.select("task", "ball_files", "ball_lines", "key_files", F.round(F.col("found") / F.col("key_files"), 6).alias("recall"), F.round(F.col("found") / F.col("ball_files"), 6).alias("precision"), F.round(F.col("ball_files") / F.greatest(F.col("files") - 1, F.lit(1)), 6).alias("share"))


@query(f"""WITH {_EDGES}, {_CO}, x AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e GROUP BY ALL), y AS (SELECT least(seed, path) AS a, greatest(seed, path) AS b FROM co GROUP BY ALL)
SELECT count(*) FILTER (x.a IS NOT NULL AND y.a IS NOT NULL) AS both_n, count(*) FILTER (y.a IS NULL) AS only_a, count(*) FILTER (x.a IS NULL) AS only_b,
round(count(*) FILTER (x.a IS NOT NULL AND y.a IS NOT NULL) / count(*), 6) AS jaccard FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b""")
def edge_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The follows-graph against the co-change graph, both without direction."""
    pair = lambda df, p, q: df.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()
    x = pair(S.graph_edges(spark, d), "src", "dst").withColumn("x", F.lit(1))
    y = pair(G.cochange(_commits(spark, d)), "seed", "path").withColumn("y", F.lit(1))
    j = x.join(y, ["a", "b"], "full_outer")
    return j.agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("both_n"), F.count(F.when(F.col("y").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_b"), F.round(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)) / F.count("*"), 6).alias("jaccard"))
