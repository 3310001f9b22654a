"""Queries on joins, windows, aggregates and statistics over the star tables and events."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import retrieval, stats
from orrery.sources import tables as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_ROWS = "ev AS (SELECT event_id AS task, user_id AS pr, user_id % 7 AS repo, event_type AS method, value AS auc FROM events), pm AS (SELECT pr, repo, method, avg(auc) AS auc FROM ev GROUP BY ALL)"


def _pm(spark: SparkSession, d: str) -> DataFrame:
    return S.scores(spark, d).groupBy("pr", "repo", "method").agg(F.avg("auc").alias("auc"))


@query(f"WITH {_ROWS} SELECT pr, repo, method, round(auc, 6) AS auc FROM pm")
def pr_level(spark: SparkSession, d: str) -> DataFrame:
    return _pm(spark, d).withColumn("auc", F.round("auc", 6))


@query(f"WITH {_ROWS} SELECT repo, method, round(avg(auc), 6) AS auc FROM pm GROUP BY ALL")
def repo_level(spark: SparkSession, d: str) -> DataFrame:
    return _pm(spark, d).groupBy("repo", "method").agg(F.round(F.avg("auc"), 6).alias("auc"))


_TABLE = f"{_ROWS}, tb AS (SELECT method, round(avg(auc), 6) AS auc FROM pm GROUP BY ALL)"


def _auc_table(spark: SparkSession, d: str) -> DataFrame:
    return _pm(spark, d).groupBy("method").agg(F.round(F.avg("auc"), 6).alias("auc"))


@query(f"WITH {_TABLE} SELECT method, auc, rank() OVER (ORDER BY auc DESC) AS rank FROM tb")
def rank_min(spark: SparkSession, d: str) -> DataFrame:
    return _auc_table(spark, d).withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("auc"))).cast("long"))


@query(f"WITH {_TABLE}, rk AS (SELECT * FROM tb WHERE method <> 'click') SELECT method, auc, 1 + (SELECT count(*) FROM rk WHERE rk.auc > tb.auc) AS rank FROM tb")
def rank_if_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The rank that each method has, or would have, among the ranked ones ('click' is not ranked)."""
    t = _auc_table(spark, d)
    better = t.where("method <> 'click'").select(F.col("auc").alias("other"))
    return t.join(F.broadcast(better), F.col("other") > F.col("auc"), "left").groupBy("method", "auc").agg((1 + F.count("other")).alias("rank"))


_REPO = f"WITH {_ROWS}, rl AS (SELECT repo, method, round(avg(auc), 6) AS auc FROM pm GROUP BY ALL), rr AS (SELECT *, rank() OVER (PARTITION BY repo ORDER BY auc DESC) AS rk, max(auc) OVER (PARTITION BY repo) - auc AS gap FROM rl)"


@query(f"{_REPO} SELECT method, max(rk) AS worst_case, round(max(gap), 4) AS worst_gap FROM rr GROUP BY method")
def worst_case_gap(spark: SparkSession, d: str) -> DataFrame:
    rl = QUERIES["repo_level"](spark, d)
    w = Window.partitionBy("repo")
    rr = rl.withColumn("rk", F.rank().over(w.orderBy(F.desc("auc")))).withColumn("gap", F.max("auc").over(w) - F.col("auc"))
    return rr.groupBy("method").agg(F.max("rk").cast("long").alias("worst_case"), F.round(F.max("gap"), 4).alias("worst_gap"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, also FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r, array_to_string(list_sort(list_distinct(list(o_orderpriority) OVER (PARTITION BY o_custkey))), ';') AS also FROM orders) WHERE r = 1")
def dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer by priority and key, with all priorities it occurs in."""
    o = S.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_orderkey")).alias("f"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("also")).select("o_custkey", "f.o_orderpriority", "f.o_orderkey", "also")


@query("SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE r = 1")
def first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    return S.first_nonblank(S.table(spark, d, "conversations"), "conv_id", "text", ["turn", "role", "text"]).select("conv_id", "text")


# The salts 20260922 and 42 of the hashed draws.
@query("SELECT c_nationkey AS repo, c_custkey AS id, draw_rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('20260922' || c_name)) AS draw_rank FROM customer) WHERE draw_rank <= 20")
def draw_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most twenty customers of each nation, by a hashed draw (the cap is the operator)."""
    w = Window.partitionBy("c_nationkey").orderBy(F.sha2(F.concat(F.lit("20260922"), "c_name"), 256))
    return S.table(spark, d, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("id"), F.row_number().over(w).alias("draw_rank")).where("draw_rank <= 20")


@query("SELECT c_mktsegment AS stratum, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42' || c_name)) AS r FROM customer) WHERE r <= 10 + length(c_mktsegment) UNION SELECT c_mktsegment, c_custkey FROM customer WHERE c_nationkey = 0")
def draw_stratified(spark: SparkSession, d: str) -> DataFrame:
    """A hashed draw of n per stratum, and a fixed block added to it."""
    c = S.table(spark, d, "customer")
    w = Window.partitionBy("c_mktsegment").orderBy(F.sha2(F.concat(F.lit("42"), "c_name"), 256))
    drawn = c.withColumn("r", F.row_number().over(w)).where("r <= 10 + length(c_mktsegment)")
    cols = [F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("id")]
    return drawn.select(*cols).union(c.where("c_nationkey = 0").select(*cols)).distinct()


@query("WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= q[1] THEN 1 WHEN p_retailprice <= q[2] THEN 2 WHEN p_retailprice <= q[3] THEN 3 ELSE 4 END AS bin FROM part, q")
def size_quartiles(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    q = F.broadcast(p.agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    x = F.col("p_retailprice")
    return p.crossJoin(q).select("p_partkey", F.when(x <= F.col("q")[0], 1).when(x <= F.col("q")[1], 2).when(x <= F.col("q")[2], 3).otherwise(4).alias("bin"))


@query("WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN r <= 1 + (n - 1) / 3.0 THEN 'small' WHEN r <= 1 + 2 * (n - 1) / 3.0 THEN 'medium' ELSE 'large' END AS size FROM r")
def size_terciles(spark: SparkSession, d: str) -> DataFrame:
    r = G.positions(S.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")], "r")
    return r.select("s_suppkey", F.when(F.col("r") <= 1 + (F.col("n") - 1) / 3.0, "small").when(F.col("r") <= 1 + 2 * (F.col("n") - 1) / 3.0, "medium").otherwise("large").alias("size"))


@query("SELECT r_name AS region, seg AS segment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN (SELECT c_custkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey AND c_mktsegment = seg GROUP BY ALL")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Customers by region and segment; combinations without a customer count 0."""
    regions, c = S.table(spark, d, "region"), S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = c.groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    cells = retrieval.against_all(S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct(), regions.select("r_regionkey", F.col("r_name").alias("region")), "segment")
    return cells.join(found, ["r_regionkey", "segment"], "left").select("region", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type AS method, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.percentile("value", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"))
    return e.select("method", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))))


@query("SELECT c_nationkey AS repo, count(*) AS n, CAST(sum(c_acctbal > 0) AS BIGINT) AS pos, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS med, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_mktsegment) AS kinds, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segs, round(100 * avg(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END), 1) AS pct FROM customer GROUP BY ALL")
def named_aggregates(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("n"), F.sum((b > 0).cast("long")).alias("pos"), F.round(F.avg(b), 4).alias("mean"), F.round(F.median(b), 4).alias("med"), F.min(b).alias("lo"), F.max(b).alias("hi"), F.countDistinct("c_mktsegment").alias("kinds"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("segs"), F.round(100 * F.avg((b > 5000).cast("int")), 1).alias("pct"))


@query("SELECT o_orderpriority AS dataset, lo, cap, count(*) FILTER (n BETWEEN lo AND 10 AND qty <= cap) AS kept FROM (SELECT o_orderpriority, o_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), (SELECT unnest([1, 2, 3]) AS lo), (SELECT unnest([50, 100, 200]) AS cap) GROUP BY ALL")
def grid_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that pass each combination of least files and most lines."""
    per = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    grid = spark.createDataFrame([(lo, cap) for lo in (1, 2, 3) for cap in (50, 100, 200)], "lo int, cap int")
    t = S.table(spark, d, "orders").join(per, "o_orderkey").crossJoin(F.broadcast(grid))
    return t.groupBy(F.col("o_orderpriority").alias("dataset"), "lo", "cap").agg(F.count(F.when(F.col("n").between(F.col("lo"), 10) & (F.col("qty") <= F.col("cap")), 1)).alias("kept"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 1 AND 10 AND sum(l_quantity) <= 200 AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 1)")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    """Changed files within bounds, changed lines at most 200, one failing test at least."""
    per = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("lines"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("f2p"))
    return S.table(spark, d, "orders").select("o_orderkey").join(per.where("n BETWEEN 1 AND 10 AND lines <= 200 AND coalesce(f2p, 0) >= 1"), "o_orderkey", "left_semi")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY ALL")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), k AS (SELECT DISTINCT round_even(g.j * (n - 1) / 4.0, 0)::BIGINT AS i FROM (SELECT DISTINCT n FROM r), (SELECT unnest(range(5)) AS j) g) SELECT s_suppkey, i FROM r JOIN k USING (i)")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Five suppliers at even distances of the sorted order."""
    r = G.positions(S.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")], "i").withColumn("i", F.col("i") - 1)
    at = F.array(*(F.bround(F.lit(j) * (F.col("n") - 1) / 4.0, 0).cast("long") for j in range(5)))
    return r.where(F.array_contains(at, F.col("i"))).select("s_suppkey", "i")


_SHARED = "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')"


@query(f"{_SHARED} SELECT user_id AS pr FROM a INTERSECT SELECT user_id FROM b")
def shared_prs(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("user_id").alias("pr"), "event_type")
    return e.where("event_type = 'click'").select("pr").intersect(e.where("event_type = 'purchase'").select("pr"))


@query(f"{_SHARED} SELECT user_id AS pr FROM a EXCEPT SELECT user_id FROM b")
def only_prs(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("user_id").alias("pr"), "event_type")
    return e.where("event_type = 'click'").select("pr").distinct().join(e.where("event_type = 'purchase'"), "pr", "left_anti")


_MET = f"WITH {_ROWS}, full_ AS (SELECT pr FROM pm GROUP BY pr HAVING count(*) = (SELECT count(DISTINCT method) FROM pm)), pc AS (SELECT pm.* FROM pm JOIN full_ USING (pr)), pp AS (SELECT x.method AS a, y.method AS b, x.pr, x.auc AS ax, y.auc AS ay, round(x.auc - y.auc, 9) AS d FROM pc x JOIN pc y ON x.pr = y.pr AND x.method < y.method)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Complete cases: PRs that have all methods; each pair of methods once."""
    pm = _pm(spark, d)
    m = F.broadcast(pm.agg(F.countDistinct("method").alias("m")))
    whole = pm.groupBy("pr").agg(F.count("*").alias("n")).crossJoin(m).where("n = m").select("pr")
    pc = pm.join(whole, "pr", "left_semi")
    x, y = pc.select("pr", F.col("method").alias("a"), F.col("auc").alias("ax")), pc.select("pr", F.col("method").alias("b"), F.col("auc").alias("ay"))
    return x.join(y, "pr").where("a < b").withColumn("d", F.round(F.col("ax") - F.col("ay"), 9))


@query(f"{_MET} SELECT a, b, count(*) AS n_pr, round(avg(ax), 6) AS mean_a, round(avg(ay), 6) AS mean_b, round(avg(d), 6) AS delta FROM pp GROUP BY ALL")
def pairwise(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n_pr"), F.round(F.avg("ax"), 6).alias("mean_a"), F.round(F.avg("ay"), 6).alias("mean_b"), F.round(F.avg("d"), 6).alias("delta"))


@query(f"{_MET}, r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM pp WHERE d <> 0) SELECT a, b, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 3) AS w_plus FROM r GROUP BY ALL")
def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    r = stats.average_rank(_pairs(spark, d).where("d <> 0").withColumn("ad", F.abs("d")), ["a", "b"], "ad", "r")
    return r.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), 3).alias("w_plus"))


@query()
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    p = stats.wilcoxon(_pairs(spark, d).select("a", "b", "d"), ["a", "b"], "a string, b string")
    p = p.withColumn("id", F.concat_ws("|", "a", "b")).withColumn("family", F.lit("all"))
    return stats.holm(p, ["family"]).drop("id", "family")


@query(f"{_MET}, z AS (SELECT a, b, ax AS x, 1 AS g FROM pp UNION ALL SELECT a, b, ay, 0 FROM pp), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS r FROM z), s AS (SELECT a, b, sum(CASE WHEN g = 1 THEN r END) AS s, sum(g) AS m FROM r GROUP BY ALL) SELECT a, b, round((s - m * (m + 1) / 2.0) / (m * m), 6) AS a12 FROM s")
def a12(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    z = p.select("a", "b", F.col("ax").alias("x"), F.lit(1).alias("g")).union(p.select("a", "b", "ay", F.lit(0)))
    return stats.a12(z, ["a", "b"], "g").withColumn("a12", F.round("a12", 6))


_P = f"{_MET}, t AS (SELECT a, b, a || '|' || b AS id, round(1 / (1 + abs(avg(d)) * 100), 6) AS p FROM pp GROUP BY ALL), h AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) - 1 AS i FROM t)"


@query(f"{_P} SELECT a, b, p, round(least(1.0, max(p * (m - i)) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h")
def holm(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d).groupBy("a", "b").agg(F.round(1 / (1 + F.abs(F.avg("d")) * 100), 6).alias("p")).withColumn("id", F.concat_ws("|", "a", "b")).withColumn("f", F.lit(1))
    return stats.holm(t, ["f"]).select("a", "b", "p", F.round("p_holm", 6).alias("p_holm"))


_TWO = f"WITH {_ROWS}, o AS (SELECT method, round(avg(CASE WHEN repo < 3 THEN auc END), 6) AS x, round(avg(CASE WHEN repo >= 3 THEN auc END), 6) AS y FROM pm GROUP BY ALL)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    return _pm(spark, d).groupBy("method").agg(F.round(F.avg(F.when(F.col("repo") < 3, F.col("auc"))), 6).alias("x"), F.round(F.avg(F.when(F.col("repo") >= 3, F.col("auc"))), 6).alias("y"))


@query(f"{_TWO}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM o) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    t = _two(spark, d).withColumn("o", F.lit(1))
    t = stats.average_rank(stats.average_rank(t, ["o"], "x", "rx"), ["o"], "y", "ry")
    return t.agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


@query(f"{_TWO}, s AS (SELECT sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy FROM o p JOIN o q ON p.method < q.method) SELECT round(sum(sx * sy) / sqrt(sum(sx * sx) * sum(sy * sy)), 6) AS tau FROM s")
def kendall(spark: SparkSession, d: str) -> DataFrame:
    """Tau-b over pairs of methods; the method table is one row per method."""
    o = _two(spark, d)
    s = o.alias("p").join(o.alias("q"), F.col("p.method") < F.col("q.method")).select(F.sign(F.col("p.x") - F.col("q.x")).alias("sx"), F.sign(F.col("p.y") - F.col("q.y")).alias("sy"))
    return s.agg(F.round(F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.sum(F.col("sx") * F.col("sx")) * F.sum(F.col("sy") * F.col("sy"))), 6).alias("tau"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    g = _pm(spark, d).groupBy("method", F.col("repo").alias("unit")).agg(F.sum("auc").alias("s"), F.count("*").alias("n"))
    return stats.bootstrap_ci(g, ["method"])


@query()
def mixedlm(spark: SparkSession, d: str) -> DataFrame:
    """Mean paired difference of each pair of methods with a random intercept per repository."""
    import numpy as np
    import pandas as pd

    g = _pairs(spark, d).groupBy("a", "b", (F.col("pr") % 7).alias("repo")).agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, se = stats.random_intercept(*(pdf[c].to_numpy(float) for c in ("n", "s", "q")))
        return pd.DataFrame({"a": [pdf.a.iloc[0]], "b": [pdf.b.iloc[0]], "estimate": [mu], "lo": [mu - 1.959964 * se], "hi": [mu + 1.959964 * se]})

    return g.groupBy("a", "b").applyInPandas(fit, "a string, b string, estimate double, lo double, hi double")


#: Half-splits.
_SPLITS = 200
_HELD = f"WITH {_ROWS}, sp AS (SELECT s AS split, repo, row_number() OVER (PARTITION BY s ORDER BY sha256(s || '|' || repo)) <= 3 AS train FROM (SELECT DISTINCT repo FROM pm), (SELECT unnest(range({_SPLITS})) AS s)), m AS (SELECT split, train, method, round(avg(auc), 6) AS auc FROM sp JOIN pm USING (repo) GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY split, train ORDER BY auc DESC) AS rk FROM m), w AS (SELECT split, arg_min(method, (rk, method)) AS chosen FROM r WHERE train GROUP BY ALL)"


@query(f"{_HELD} SELECT r.split, chosen, rk AS rank, auc FROM w JOIN r ON r.split = w.split AND r.method = w.chosen AND NOT r.train")
def heldout_splits(spark: SparkSession, d: str) -> DataFrame:
    """The method that half of the repositories choose, and its rank on the other half."""
    pm = _pm(spark, d)
    repos = pm.select("repo").distinct().crossJoin(F.broadcast(spark.range(_SPLITS).withColumnRenamed("id", "split")))
    w = Window.partitionBy("split").orderBy(F.sha2(F.concat_ws("|", F.col("split").cast("string"), F.col("repo").cast("string")), 256))
    sp = repos.withColumn("train", F.row_number().over(w) <= 3)
    m = pm.join(F.broadcast(sp), "repo").groupBy("split", "train", "method").agg(F.round(F.avg("auc"), 6).alias("auc"))
    r = m.withColumn("rk", F.rank().over(Window.partitionBy("split", "train").orderBy(F.desc("auc"))).cast("long"))
    best = r.where("train").groupBy("split").agg(F.min_by("method", F.struct("rk", "method")).alias("method"))
    return r.where("NOT train").join(best, ["split", "method"]).select("split", F.col("method").alias("chosen"), F.col("rk").alias("rank"), "auc")


@query("WITH l AS (SELECT l_suppkey AS text_id, l_orderkey % 1000 AS s, l_orderkey % 1000 + l_quantity::BIGINT AS e FROM lineitem), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY text_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM l), g AS (SELECT *, sum(new) OVER (PARTITION BY text_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT text_id, min(s) AS s, max(e) AS e FROM g GROUP BY text_id, g")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Spans that overlap or touch become one; lengths are rounded as SQL's cast does, spans without a start or an end come last."""
    l = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("text_id"), (F.col("l_orderkey") % 1000).alias("s"), (F.col("l_orderkey") % 1000 + F.rint("l_quantity").cast("long")).alias("e"))  # noqa: E741
    w = Window.partitionBy("text_id").orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    m = l.withColumn("new", F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    g = m.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("text_id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


_TOP = "t AS (SELECT s AS method, l_orderkey AS task, l_partkey AS path FROM (SELECT l_returnflag AS s, l_orderkey, l_partkey FROM lineitem) GROUP BY ALL)"


@query(f"WITH {_TOP}, n AS (SELECT method, task, count(*) AS n FROM t GROUP BY ALL), i AS (SELECT x.method AS a, y.method AS b, x.task, count(*) AS i FROM t x JOIN t y ON x.task = y.task AND x.path = y.path AND x.method < y.method GROUP BY ALL), p AS (SELECT p.method AS a, q.method AS b, p.task, p.n AS na, q.n AS nb FROM n p JOIN n q ON p.task = q.task AND p.method < q.method) SELECT a, b, count(*) AS tasks, round(avg(coalesce(i, 0) / (na + nb - coalesce(i, 0))), 6) AS jaccard FROM p LEFT JOIN i USING (a, b, task) GROUP BY ALL")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    """Mean Jaccard overlap of two methods' lists over tasks that both have (lists: parts by return flag and order)."""
    t = S.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("path")).distinct()
    x, y = t.withColumnRenamed("method", "a"), t.withColumnRenamed("method", "b")
    i = x.join(y, ["task", "path"]).where("a < b").groupBy("a", "b", "task").agg(F.count("*").alias("i"))
    n = t.groupBy("method", "task").agg(F.count("*").alias("n"))
    p = n.select(F.col("method").alias("a"), "task", F.col("n").alias("na")).join(n.select(F.col("method").alias("b"), "task", F.col("n").alias("nb")), "task").where("a < b")
    common = F.coalesce("i", F.lit(0))
    return p.join(i, ["a", "b", "task"], "left").groupBy("a", "b").agg(F.count("*").alias("tasks"), F.round(F.avg(common / (F.col("na") + F.col("nb") - common)), 6).alias("jaccard"))


@query("WITH l AS (SELECT doc_id, quality, toxic FROM labels), s AS (SELECT unnest(['all', 'good', 'clean', 'good_clean', 'toxic']) AS stratum), x AS (SELECT stratum, l.doc_id FROM l, s WHERE stratum = 'all' OR (stratum = 'good' AND quality = 1) OR (stratum = 'clean' AND toxic = 0) OR (stratum = 'good_clean' AND quality = 1 AND toxic = 0) OR (stratum = 'toxic' AND toxic = 1)) SELECT stratum, source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM x JOIN documents USING (doc_id) GROUP BY ALL")
def leak_strata(spark: SparkSession, d: str) -> DataFrame:
    """Named, overlapping subpopulations, each with its own aggregates."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    names = F.array_compact(F.array(F.lit("all"), F.when(good, F.lit("good")), F.when(~toxic, F.lit("clean")), F.when(good & ~toxic, F.lit("good_clean")), F.when(toxic, F.lit("toxic"))))
    x = S.table(spark, d, "labels").select("doc_id", F.explode(names).alias("stratum"))
    return x.join(S.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").groupBy("stratum", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


