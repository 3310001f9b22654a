"""The study's analysis over scored orderings of the corpus of ordering_plans, with its SQL.

A pull request is a brand and the length of a type's name, so that some have several tasks. The
tables have no issue reports; a task counts as leaking by what its issue's words share with its
key files (see `strata`).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import orderings as O
from orrery.operators import scoring, stats
from orrery.plans import ordering_plans as P
from orrery.plans.ordering_plans import with_parts
from orrery.staging import stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Orderings that are scored; the ranked ones are compared with each other.
RANKED = ("hops_lines", "ppr_und_pl", "bm25_issue", "path_issue", "rrf_hops_path", "rrf_pprpl_issue_path")
SCORED = (*RANKED, "bm25_issue_rd", "rrf_pprpl_issue_path_rd", "random")
REDACTED = {"bm25_issue_rd": "bm25_issue", "rrf_pprpl_issue_path_rd": "rrf_pprpl_issue_path"}
STRUCTURE, WORDS = ("ppr_und_pl", "hops_lines"), ("bm25_issue", "path_issue")
TOP = 10


def query(sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_parts(sql, *needs)
        return f

    return put


_MADE: dict[tuple[str, str, str], DataFrame] = {}


def _made(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    at = spark.sparkContext.applicationId, d, name
    if at not in _MADE:
        for old in [k for k in _MADE if k[:2] != at[:2]]:
            del _MADE[old]
        _MADE[at] = stage(make(), name)
    return _MADE[at]


def _key(spark: SparkSession, d: str) -> DataFrame:
    """(task, source, path): key files in the graph, without the seed."""
    # A key's files meet the files of the task's repository by path: files of all tasks are not made for them.
    c = P.corpus(spark, d)
    seeds = c.nodes.select("repo", F.col("path").alias("seed"))
    tasks = F.broadcast(c.tasks.join(seeds, ["repo", "seed"], "left_semi"))
    return _made(spark, d, "key", lambda: P.keys(spark, d).join(tasks, "task").where("path <> seed").join(c.nodes.select("repo", "path"), ["repo", "path"]).select("task", "source", "path"))


def _best(spark: SparkSession, d: str) -> DataFrame:
    """(task, source, path, pos, cost, cum): a key's files in the best order there is."""

    def make() -> DataFrame:
        c = P.corpus(spark, d)
        order = O.oracle(c, _key(spark, d)).join(c.others.select("task", "path", "cost"), ["task", "path"])
        w = Window.partitionBy("task", "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return order.select("task", "source", "path", "pos", "cost", F.sum("cost").over(w).alias("cum"))

    return _made(spark, d, "best", make)


def _found(spark: SparkSession, d: str) -> DataFrame:
    """(task, source, method, path, pos, cum, hits, key_size): where all scored orderings and the oracle have a key's files.

    Lines are counted once along each ordering, whatever keys there are, and of its files only those of a key are kept:
    all measures change at these files only.
    """

    def make() -> DataFrame:
        c, key = P.corpus(spark, d), _key(spark, d)
        size = key.groupBy("task", "source").agg(F.count("*").alias("key_size"))
        w = Window.partitionBy("task", "method").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        # Paths of key files only go along into the windows.
        keyed = key.select("task", "path", F.lit(True).alias("keyed")).distinct()
        files = stage(c.others.select("task", "path", "cost").join(keyed, ["task", "path"], "left"), "costs")
        o = O.union_all(c, list(SCORED)).join(files, ["task", "path"]).select("task", "method", "pos", "cost", F.when(F.col("keyed"), F.col("path")).alias("path"))
        o = o.withColumn("cum", F.sum("cost").over(w)).where("path IS NOT NULL")
        o = o.join(key, ["task", "path"]).select("task", "source", "method", "path", "pos", "cum")
        o = o.unionByName(_best(spark, d).select("task", "source", F.lit("oracle").alias("method"), "path", "pos", "cum"))
        hits = F.row_number().over(Window.partitionBy("task", "source", "method").orderBy("pos"))
        return o.withColumn("hits", hits).join(size, ["task", "source"])

    return _made(spark, d, "found", make)


def _about(spark: SparkSession, d: str) -> DataFrame:
    """(task, repo, pr, n_nodes)."""
    c = P.corpus(spark, d)
    size = c.nodes.groupBy("repo").agg(F.count("*").alias("n_nodes"))
    return c.tasks.join(size, "repo").select("task", "repo", F.concat("repo", F.lit("#"), (F.length(F.substring_index("task", "|", -1)) % 3).cast("string")).alias("pr"), "n_nodes")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    methods = spark.createDataFrame([(m,) for m in (*SCORED, "oracle")], "method string")
    return _key(spark, d).groupBy("task", "source").agg(F.count("*").alias("key_size")).crossJoin(F.broadcast(methods))


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """(task, source, method, budget, coverage); an ordering without rows covers nothing."""

    def make() -> DataFrame:
        share = [F.struct(F.lit(b).alias("budget"), (F.count(F.when(F.col("cum") <= b, 1)) / F.max("key_size")).alias("coverage")) for b in scoring.BUDGETS]
        own = _found(spark, d).groupBy("task", "source", "method").agg(F.array(*share).alias("x")).select("task", "source", "method", F.inline("x"))
        g = _grid(spark, d).drop("key_size").crossJoin(scoring.budgets(spark))
        return g.join(own, ["task", "source", "method", "budget"], "left").select("task", "source", "method", "budget", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))

    return _made(spark, d, "curves", make)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(task, pr, repo, n_nodes, method, source, key_size, auc, auc_files, lines_half, lines_all)."""

    def make() -> DataFrame:
        auc = _curves(spark, d).groupBy("task", "source", "method").agg(F.avg("coverage").alias("auc"))
        size = F.max("key_size")
        shares = F.array(*(F.count(F.when(F.col("pos") <= b, 1)) / size for b in scoring.FILE_BUDGETS))
        mean = F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) / len(scoring.FILE_BUDGETS)
        first = lambda need: F.min(F.when(F.col("hits") >= need, F.col("cum")))
        part = _found(spark, d).groupBy("task", "source", "method").agg(mean.alias("auc_files"), first(F.ceil(F.col("key_size") * 0.5)).alias("lines_half"), first(F.col("key_size")).alias("lines_all"))
        out = _grid(spark, d).join(auc, ["task", "source", "method"]).join(part, ["task", "source", "method"], "left")
        return out.fillna(0.0, ["auc_files"]).join(_about(spark, d), "task")

    return _made(spark, d, "rows", make)


# SQL parts on top of those of the orderings.
_PARTS = P._PARTS
_PARTS["key"] = ("SELECT DISTINCT k.task, k.source, k.path FROM keys k JOIN others o ON o.task = k.task AND o.path = k.path", ("keys", "others"))
_PARTS["ks"] = ("SELECT task, source, count(*) AS key_size FROM key GROUP BY ALL", ("key",))
_PARTS["lists"] = (" UNION ALL ".join(f"SELECT task, '{m}' AS method, path, pos FROM o_{m}" for m in SCORED), tuple(f"o_{m}" for m in SCORED))
_PARTS["ord"] = (
    """SELECT l.task, ks.source, l.method, l.path, l.pos, o.cost, CASE WHEN key.path IS NULL THEN 0 ELSE 1 END AS in_key, key_size FROM lists l JOIN ks ON ks.task = l.task JOIN others o ON o.task = l.task AND o.path = l.path LEFT JOIN key ON key.task = l.task AND key.source = ks.source AND key.path = l.path
UNION ALL SELECT key.task, key.source, 'oracle', key.path, row_number() OVER (PARTITION BY key.task, key.source ORDER BY cost, sha256(key.task || '|' || key.path)), cost, 1, key_size FROM key JOIN others o ON o.task = key.task AND o.path = key.path JOIN ks ON ks.task = key.task AND ks.source = key.source""",
    ("lists", "ks", "others", "key"),
)
_PARTS["run"] = ("SELECT *, sum(cost) OVER w AS cum, sum(in_key) OVER w AS hits FROM ord WINDOW w AS (PARTITION BY task, source, method ORDER BY pos ROWS UNBOUNDED PRECEDING)", ("ord",))
_PARTS["grid"] = (f"SELECT task, source, key_size, unnest({[*SCORED, 'oracle']}) AS method FROM ks", ("ks",))
_PARTS["curves"] = (
    "SELECT g.task, g.source, g.method, g.budget, coalesce(sum(CASE WHEN cum <= budget THEN in_key ELSE 0 END) / any_value(g.key_size), 0) AS coverage FROM (SELECT *, unnest([250,500,1000,2000,4000,8000,16000,32000]) AS budget FROM grid) g LEFT JOIN run r ON r.task = g.task AND r.source = g.source AND r.method = g.method GROUP BY ALL",
    ("grid", "run"),
)
_PARTS["about"] = ("SELECT task, t.repo, t.repo || '#' || (length(split_part(task, '|', 2)) % 3) AS pr, s.n AS n_nodes FROM tasks t JOIN size s ON s.repo = t.repo", ("tasks", "size"))
_PARTS["scored"] = (
    """SELECT c.task, a.repo, a.pr, a.n_nodes, c.source, c.method, avg(coverage) AS auc FROM curves c JOIN about a ON a.task = c.task GROUP BY ALL""",
    ("curves", "about"),
)
_PARTS["reach"] = ("SELECT task, source, method, CAST(min(CASE WHEN hits >= ceil(key_size * 0.5) THEN cum END) AS BIGINT) AS lines_half, CAST(min(CASE WHEN hits >= key_size THEN cum END) AS BIGINT) AS lines_all FROM run GROUP BY ALL", ("run",))
_PARTS["by_files"] = ("SELECT task, source, method, sum(least(1.0, x.s / key_size)) / 8 AS auc_files FROM (SELECT task, source, method, any_value(key_size) AS key_size, b, sum(CASE WHEN pos <= b THEN in_key ELSE 0 END) AS s FROM ord, (SELECT unnest([1,2,4,8,16,32,64,128]) AS b) GROUP BY ALL) x GROUP BY ALL", ("ord",))
_PARTS["pr_rows"] = ("SELECT source, method, repo, pr, avg(auc) AS auc FROM scored GROUP BY ALL", ("scored",))
_PARTS["shared"] = ("SELECT pr FROM pr_rows GROUP BY pr HAVING count(DISTINCT source) = 2", ("pr_rows",))
_PARTS["leaks"] = (
    """SELECT task, max(full_) AS named, max(n >= 1) AS stem, max(n >= 2) AS explicit FROM (SELECT k.task, k.path, any_value(f.p_name = t.issue AND t.hi <> t.lo) AS full_, count(q.term) AS n FROM key k JOIN tasks t ON t.task = k.task JOIN nodes f ON f.repo = t.repo AND f.path = k.path LEFT JOIN (SELECT q.task, b.path, q.term FROM q_none q JOIN others o ON o.task = q.task JOIN paths b ON b.repo = o.repo AND b.path = o.path AND b.term = q.term) q ON q.task = k.task AND q.path = k.path GROUP BY k.task, k.path) GROUP BY task""",
    ("key", "tasks", "nodes", "q_none", "others", "paths"),
)
_PARTS["strata"] = (
    "SELECT unnest(list_filter([CASE WHEN TRUE THEN 'all' END, CASE WHEN NOT named THEN 'no_full_path' END, CASE WHEN NOT named AND NOT explicit THEN 'no_explicit' END, CASE WHEN NOT named AND NOT stem THEN 'no_stem' END, CASE WHEN named OR explicit THEN 'explicit' END], lambda x: x IS NOT NULL)) AS stratum, task FROM leaks",
    ("leaks",),
)


def _six(mean) -> Column:
    """Six digits of a mean. Means of shares often end in ...5 at the seventh, where the last bit of the sum would decide: a hair is added first."""
    return F.round(mean + F.lit(1e-9), 6)


@query("SELECT s.task, s.pr, s.repo, s.source, s.method, round(s.auc + 1e-9, 6) AS auc, round(coalesce(auc_files, 0) + 1e-9, 6) AS auc_files, CAST(lines_half AS DOUBLE) AS lines_half, CAST(lines_all AS DOUBLE) AS lines_all FROM scored s LEFT JOIN by_files f ON f.task = s.task AND f.source = s.source AND f.method = s.method LEFT JOIN reach r ON r.task = s.task AND r.source = s.source AND r.method = s.method", "scored", "by_files", "reach")
def study_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("task", "pr", "repo", "source", "method", _six(F.col("auc")).alias("auc"), _six(F.col("auc_files")).alias("auc_files"), F.col("lines_half").cast("double").alias("lines_half"), F.col("lines_all").cast("double").alias("lines_all"))


@query("SELECT task, source, method, CAST(budget AS INT) AS budget, round(coverage, 6) AS coverage FROM curves", "curves")
def study_curves(spark: SparkSession, d: str) -> DataFrame:
    return _curves(spark, d).withColumn("budget", F.col("budget").cast("int")).withColumn("coverage", F.round("coverage", 6))


def _pr_rows(r: DataFrame) -> DataFrame:
    return r.groupBy("source", "method", "repo", "pr").agg(F.avg("auc").alias("auc"))


def _shared(pr: DataFrame) -> DataFrame:
    """Pull requests with a key under both sources."""
    return pr.groupBy("pr").agg(F.countDistinct("source").alias("n")).where("n = 2").select("pr")


def _ranked(t: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """t with ranks (smallest of equals, descending) of the ranked orderings; the others get none."""
    own = F.col("method").isin(*RANKED)
    return t.withColumn(name, F.when(own, F.rank().over(Window.partitionBy(*by, own.cast("int")).orderBy(F.desc(value))).cast("double")))


_IS = f"method IN {RANKED}"


def _rank_sql(by: str, value: str, name: str) -> str:
    return f"CASE WHEN {_IS} THEN CAST(rank() OVER (PARTITION BY {by}, {_IS} ORDER BY {value} DESC) AS DOUBLE) END AS {name}"


@query(f"SELECT *, {_rank_sql('source', 'auc', 'rank')} FROM (SELECT source, method, count(*) AS n_pr, round(avg(auc) + 1e-9, 6) AS auc FROM pr_rows GROUP BY ALL)", "pr_rows")
def study_auc_table(spark: SparkSession, d: str) -> DataFrame:
    t = _pr_rows(rows(spark, d)).groupBy("source", "method").agg(F.count("*").alias("n_pr"), _six(F.avg("auc")).alias("auc"))
    return _ranked(t, ["source"], "auc", "rank")


@query("SELECT pr FROM shared", "shared")
def study_shared_prs(spark: SparkSession, d: str) -> DataFrame:
    """Which keys a task has decides: every task is scored under each of them."""
    return _shared(_key(spark, d).select("task", "source").distinct().join(_about(spark, d), "task"))


def strata(spark: SparkSession, d: str) -> DataFrame:
    """(stratum, task): named, overlapping populations. A key file is named in full if its name is the issue, as a stem if
    its path holds a word of the issue, and as code if it holds two."""

    def make() -> DataFrame:
        c, key = P.corpus(spark, d), _key(spark, d)
        f = P._files(spark, d).select("repo", "path", "p_name", "p_type", "k")
        issue = f.groupBy("repo", "p_type").agg(F.max_by("p_name", "k").alias("issue"), F.min("k").alias("lo"), F.max("k").alias("hi")).select(F.concat_ws("|", "repo", "p_type").alias("task"), "issue", "lo", "hi")
        files = key.join(c.others.select("task", "repo", "path"), ["task", "path"])
        words = files.select("task", "repo", "path").distinct().join(c.path_bags.select("repo", "path", "term"), ["repo", "path"]).join(c.queries.where("arm = 'none'").select("task", "term"), ["task", "term"]).groupBy("task", "path").agg(F.count("*").alias("n"))
        x = files.select("task", "repo", "path").distinct().join(f.select("repo", "path", "p_name"), ["repo", "path"]).join(issue, "task").join(words, ["task", "path"], "left").fillna(0, ["n"])
        own = key.join(x.select("task", "path", (F.col("n") * 1).alias("n"), ((F.col("p_name") == F.col("issue")) & (F.col("hi") != F.col("lo"))).alias("full")), ["task", "path"])
        flags = own.groupBy("task", "path").agg(F.max("full").alias("full"), F.sum("n").alias("n")).groupBy("task").agg(F.bool_or("full").alias("named"), F.bool_or(F.col("n") >= 1).alias("stem"), F.bool_or(F.col("n") >= 2).alias("explicit"))
        named, stem, code = F.col("named"), F.col("stem"), F.col("explicit")
        names = F.array_compact(F.array(F.lit("all"), F.when(~named, F.lit("no_full_path")), F.when(~named & ~code, F.lit("no_explicit")), F.when(~named & ~stem, F.lit("no_stem")), F.when(named | code, F.lit("explicit"))))
        return flags.select(F.explode(names).alias("stratum"), "task")

    return _made(spark, d, "strata", make)


@query("SELECT stratum, task FROM strata", "strata")
def study_strata(spark: SparkSession, d: str) -> DataFrame:
    return strata(spark, d)


_JOINT = "SELECT stratum, source, method, repo, pr, avg(auc) AS auc FROM scored JOIN strata USING (task) GROUP BY ALL"


@query(f"SELECT *, {_rank_sql('stratum, source', 'auc', 'rank')} FROM (SELECT stratum, source, method, count(*) AS n_pr, round(avg(auc) + 1e-9, 6) AS auc FROM ({_JOINT}) WHERE (stratum, pr) IN (SELECT (stratum, pr) FROM ({_JOINT}) GROUP BY stratum, pr HAVING count(DISTINCT source) = 2) GROUP BY ALL)", "scored", "strata")
def table_joint(spark: SparkSession, d: str) -> DataFrame:
    """Each stratum on its own matched population: pull requests with both keys inside it."""
    x = rows(spark, d).join(strata(spark, d), "task").groupBy("stratum", "source", "method", "repo", "pr").agg(F.avg("auc").alias("auc"))
    both = x.groupBy("stratum", "pr").agg(F.countDistinct("source").alias("n")).where("n = 2").select("stratum", "pr")
    t = x.join(both, ["stratum", "pr"], "left_semi").groupBy("stratum", "source", "method").agg(F.count("*").alias("n_pr"), _six(F.avg("auc")).alias("auc"))
    return _ranked(t, ["stratum", "source"], "auc", "rank")


@query(f"SELECT stratum, source, method, n_pr, auc_no_leak, CAST(rank() OVER (PARTITION BY stratum, source ORDER BY auc_no_leak DESC) AS INT) AS rank_no_leak FROM (SELECT stratum, source, method, count(*) AS n_pr, round(avg(auc) + 1e-9, 6) AS auc_no_leak FROM ({_JOINT}) WHERE stratum NOT IN ('all', 'explicit') AND {_IS} GROUP BY ALL)", "scored", "strata")
def leak_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The ranked orderings on the tasks that survive each level of the leakage control."""
    x = rows(spark, d).where(F.col("method").isin(*RANKED)).join(strata(spark, d).where("stratum NOT IN ('all', 'explicit')"), "task")
    t = x.groupBy("stratum", "source", "method", "repo", "pr").agg(F.avg("auc").alias("auc")).groupBy("stratum", "source", "method").agg(F.count("*").alias("n_pr"), _six(F.avg("auc")).alias("auc_no_leak"))
    return t.withColumn("rank_no_leak", F.rank().over(Window.partitionBy("stratum", "source").orderBy(F.desc("auc_no_leak"))).cast("int"))


def _redaction_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(group, source, method, repo, pr, x, y): plain and redacted scores of matched pull requests, by group of tasks."""
    groups = spark.createDataFrame([("names removed", "explicit"), ("nothing removed", "no_explicit"), ("all tasks", "all")], "group string, stratum string")
    r = rows(spark, d).join(strata(spark, d), "task").join(F.broadcast(groups), "stratum")
    pr = r.groupBy("group", "source", "method", "repo", "pr").agg(F.avg("auc").alias("auc"))
    both = pr.groupBy("group", "pr").agg(F.countDistinct("source").alias("n")).where("n = 2").select("group", "pr")
    pr = pr.join(both, ["group", "pr"], "left_semi")
    names = F.broadcast(spark.createDataFrame(list(REDACTED.items()), "redacted string, method string"))
    y = pr.join(names.withColumnRenamed("method", "plain"), F.col("method") == F.col("redacted")).select("group", "source", F.col("plain").alias("method"), "repo", "pr", F.col("auc").alias("y"))
    return pr.withColumnRenamed("auc", "x").join(y, ["group", "source", "method", "repo", "pr"])


_GROUP = "CASE stratum WHEN 'explicit' THEN 'names removed' WHEN 'no_explicit' THEN 'nothing removed' ELSE 'all tasks' END"
_RED = f"SELECT {_GROUP} AS \"group\", source, method, repo, pr, auc FROM ({_JOINT}) WHERE stratum IN ('explicit', 'no_explicit', 'all') AND (stratum, pr) IN (SELECT (stratum, pr) FROM ({_JOINT}) GROUP BY stratum, pr HAVING count(DISTINCT source) = 2)"


@query(f"SELECT p.\"group\", p.source, p.method, count(*) AS n, round(avg(p.auc), 6) AS auc, round(avg(q.auc), 6) AS auc_redacted, round(avg(p.auc - q.auc), 6) + 0 AS delta FROM ({_RED}) p JOIN ({_RED}) q ON p.\"group\" = q.\"group\" AND p.source = q.source AND p.pr = q.pr AND q.method = p.method || '_rd' GROUP BY ALL", "scored", "strata")
def redaction_table(spark: SparkSession, d: str) -> DataFrame:
    """What deleting key files' names from the issue costs, on the same pull requests."""
    return _redaction_pairs(spark, d).groupBy("group", "source", "method").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("auc"), F.round(F.avg("y"), 6).alias("auc_redacted"), (F.round(F.avg(F.col("x") - F.col("y")), 6) + 0.0).alias("delta"))


@query()
def redaction_tests(spark: SparkSession, d: str) -> DataFrame:
    """(group, source, method, n, p, p_holm, lo, hi): signed-rank tests of the pairs, corrected within the arm, and resampled intervals."""
    x = _redaction_pairs(spark, d).withColumn("d", F.col("x") - F.col("y"))
    keys = ["group", "source", "method"]
    p = stats.wilcoxon(x.select(*keys, "d"), keys, "group string, source string, method string").withColumn("id", F.concat_ws("|", *keys)).withColumn("arm", F.lit("names"))
    ci = stats.bootstrap_ci(x.groupBy(*keys, F.col("pr").alias("unit")).agg(F.sum("d").alias("s"), F.count("*").alias("n")), keys)
    return stats.holm(p, ["arm"]).drop("id", "arm").join(ci, keys)


@query(f"SELECT source, {TOP} AS k, count(*) AS n_key_files, round(avg(CASE WHEN s AND w THEN 1.0 ELSE 0 END), 6) AS \"both\", round(avg(CASE WHEN s AND NOT w THEN 1.0 ELSE 0 END), 6) AS struct_only, round(avg(CASE WHEN w AND NOT s THEN 1.0 ELSE 0 END), 6) AS lex_only, round(avg(CASE WHEN NOT s AND NOT w THEN 1.0 ELSE 0 END), 6) AS neither FROM (SELECT k.task, k.source, k.path, coalesce(bool_or(method IN {STRUCTURE}), FALSE) AS s, coalesce(bool_or(method IN {WORDS}), FALSE) AS w FROM key k LEFT JOIN lists l ON l.task = k.task AND l.path = k.path AND l.pos <= {TOP} GROUP BY ALL) GROUP BY source", "key", "lists")
def complementarity(spark: SparkSession, d: str) -> DataFrame:
    """How each key file is reached among the first files: by structure, by words, by both or by neither."""
    top = _found(spark, d).where(f"pos <= {TOP} AND method <> 'oracle'").select("task", "source", "path", "method")
    x = _key(spark, d).join(top, ["task", "source", "path"], "left").groupBy("task", "source", "path").agg(F.coalesce(F.bool_or(F.col("method").isin(*STRUCTURE)), F.lit(False)).alias("s"), F.coalesce(F.bool_or(F.col("method").isin(*WORDS)), F.lit(False)).alias("w"))
    s, w = F.col("s"), F.col("w")
    share = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return x.groupBy("source").agg(F.lit(TOP).alias("k"), F.count("*").alias("n_key_files"), share(s & w, "both"), share(s & ~w, "struct_only"), share(w & ~s, "lex_only"), share(~s & ~w, "neither"))


@query(f"SELECT a, b, {TOP} AS k, round(avg(i / (na + nb - i)), 6) AS jaccard, count(*) AS n FROM (SELECT p.a, p.b, t.task, count(*) FILTER (x.method = p.a) AS na, count(*) FILTER (x.method = p.b) AS nb, count(*) FILTER (x.method = p.a AND y.path IS NOT NULL) AS i FROM (SELECT p.method AS a, q.method AS b FROM (SELECT DISTINCT method FROM lists WHERE {_IS}) p JOIN (SELECT DISTINCT method FROM lists WHERE {_IS}) q ON p.method < q.method) p, (SELECT DISTINCT task FROM lists) t JOIN lists x ON x.task = t.task AND x.pos <= {TOP} AND x.method IN (p.a, p.b) LEFT JOIN lists y ON y.task = x.task AND y.path = x.path AND y.pos <= {TOP} AND x.method = p.a AND y.method = p.b GROUP BY ALL) GROUP BY ALL", "lists")
def overlap_top(spark: SparkSession, d: str) -> DataFrame:
    """Mean Jaccard overlap of the first files of each pair of ranked orderings, over tasks where either has some."""
    c = P.corpus(spark, d)
    top = O.union_all(c, list(RANKED)).where(f"pos <= {TOP}").select("task", "method", "path")
    names = spark.createDataFrame([(a, b) for a in sorted(RANKED) for b in sorted(RANKED) if a < b], "a string, b string")
    in_pair = top.join(F.broadcast(names), (F.col("method") == F.col("a")) | (F.col("method") == F.col("b")))
    per = in_pair.groupBy("a", "b", "task", "path").agg(F.count("*").alias("c")).groupBy("a", "b", "task").agg((F.count(F.when(F.col("c") == 2, 1)) / F.count("*")).alias("j"))
    return per.groupBy("a", "b").agg(F.lit(TOP).alias("k"), F.round(F.avg("j"), 6).alias("jaccard"), F.count("*").alias("n"))


_QUART = "(SELECT quantile_cont(n_nodes, [0.25, 0.5, 0.75]) AS q FROM about)"


@query(f"SELECT source, size_q, method, auc, CAST(rank() OVER (PARTITION BY source, size_q ORDER BY auc DESC) + (count(*) OVER (PARTITION BY source, size_q, auc) - 1) / 2.0 - 0.25 AS INT) AS rank FROM (SELECT source, CASE WHEN n_nodes <= q[1] THEN 'Q1' WHEN n_nodes <= q[2] THEN 'Q2' WHEN n_nodes <= q[3] THEN 'Q3' ELSE 'Q4' END AS size_q, method, round(avg(auc) + 1e-9, 6) AS auc FROM scored, {_QUART} WHERE {_IS} OR method = 'oracle' GROUP BY ALL)", "scored", "about")
def by_size(spark: SparkSession, d: str) -> DataFrame:
    """Mean of tasks and truncated average rank in each quartile of repository size, by tasks."""
    q = F.broadcast(_about(spark, d).agg(F.percentile("n_nodes", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    n = F.col("n_nodes")
    bin_ = F.when(n <= F.col("q")[0], "Q1").when(n <= F.col("q")[1], "Q2").when(n <= F.col("q")[2], "Q3").otherwise("Q4")
    x = rows(spark, d).where(F.col("method").isin(*RANKED, "oracle")).crossJoin(q).groupBy("source", bin_.alias("size_q"), "method").agg(_six(F.avg("auc")).alias("auc"))
    return stats.average_rank(x, ["source", "size_q"], "auc", "r", descending=True).select("source", "size_q", "method", "auc", F.floor("r").cast("int").alias("rank"))


@query(f"SELECT s.source, s.method, median(lines_half) AS lines_half_median, median(lines_all) AS lines_all_median, count(*) AS n_task FROM scored s LEFT JOIN reach r ON r.task = s.task AND r.source = s.source AND r.method = s.method WHERE s.{_IS} OR s.method = 'oracle' GROUP BY ALL", "scored", "reach")
def lines_table(spark: SparkSession, d: str) -> DataFrame:
    """Median lines to half and to all of the key."""
    x = rows(spark, d).where(F.col("method").isin(*RANKED, "oracle"))
    return x.groupBy("source", "method").agg(F.median("lines_half").alias("lines_half_median"), F.median("lines_all").alias("lines_all_median"), F.count("*").alias("n_task"))


@query(f"SELECT rule, source, method, round(avg(v) + 1e-9, 6) AS auc FROM (SELECT rule, source, method, pr, avg(v) AS v FROM (SELECT 'stop' AS rule, s.source, s.method, s.pr, s.auc AS v FROM scored s WHERE s.{_IS} UNION ALL SELECT 'files', s.source, s.method, s.pr, coalesce(f.auc_files, 0) FROM scored s LEFT JOIN by_files f ON f.task = s.task AND f.source = s.source AND f.method = s.method WHERE s.{_IS}) GROUP BY ALL) GROUP BY ALL", "scored", "by_files")
def metric_rules(spark: SparkSession, d: str) -> DataFrame:
    """The same orderings under the stopping rule and under budgets of files; the skipping rule is skip_curve's."""
    x = rows(spark, d).where(F.col("method").isin(*RANKED))
    long = x.select("source", "method", "pr", F.explode(F.array(F.struct(F.lit("stop").alias("rule"), F.col("auc").alias("v")), F.struct(F.lit("files").alias("rule"), F.col("auc_files").alias("v")))).alias("r")).select("source", "method", "pr", "r.*")
    return long.groupBy("rule", "source", "method", "pr").agg(F.avg("v").alias("v")).groupBy("rule", "source", "method").agg(_six(F.avg("v")).alias("auc"))


@query("SELECT source, method, round(avg(auc) + 1e-9, 6) AS auc_8000 FROM (SELECT source, method, pr, avg(auc) AS auc FROM (SELECT c.task, source, method, pr, avg(coverage) AS auc FROM curves c JOIN about a ON a.task = c.task WHERE budget <= 8000 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL", "curves", "about")
def capped_auc(spark: SparkSession, d: str) -> DataFrame:
    """AUC over the budgets up to 8,000 lines."""
    t = _curves(spark, d).where("budget <= 8000").groupBy("task", "source", "method").agg(F.avg("coverage").alias("auc")).join(_about(spark, d), "task")
    return t.groupBy("source", "method", "pr").agg(F.avg("auc").alias("auc")).groupBy("source", "method").agg(_six(F.avg("auc")).alias("auc_8000"))


@query(f"SELECT count(DISTINCT task) AS n_tasks, count(DISTINCT pr) AS n_prs, count(DISTINCT repo) AS n_repos, (SELECT count(*) FROM tasks) AS corpus_tasks, (SELECT count(*) FROM shared) AS n_shared, (SELECT string_agg(source || ':' || method, ';' ORDER BY source, rank, method) FROM (SELECT *, {_rank_sql('source', 'auc', 'rank')} FROM (SELECT source, method, round(avg(auc) + 1e-9, 6) AS auc FROM pr_rows GROUP BY ALL)) WHERE rank <= 5) AS top5 FROM scored", "scored", "tasks", "shared", "pr_rows")
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the study and the five best orderings under each source."""
    r = rows(spark, d)
    top = study_auc_table(spark, d).where("rank <= 5").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "rank", "method"))), lambda x: F.concat_ws(":", x["source"], x["method"])), ";").alias("top5"))
    n = r.agg(F.countDistinct("task").alias("n_tasks"), F.countDistinct("pr").alias("n_prs"), F.countDistinct("repo").alias("n_repos"))
    return n.crossJoin(P.corpus(spark, d).tasks.agg(F.count("*").alias("corpus_tasks"))).crossJoin(_shared(_pr_rows(r)).agg(F.count("*").alias("n_shared"))).crossJoin(top)


@query(f"WITH m AS (SELECT source, p.method AS a, q.method AS b, 'pr' AS unit, avg(p.auc - q.auc) AS delta FROM pr_rows p JOIN pr_rows q USING (source, pr) WHERE p.method < q.method AND p.{_IS} AND q.{_IS} GROUP BY ALL UNION ALL SELECT source, p.method, q.method, 'repo', avg(p.auc - q.auc) FROM (SELECT source, method, repo, avg(auc) AS auc FROM pr_rows GROUP BY ALL) p JOIN (SELECT source, method, repo, avg(auc) AS auc FROM pr_rows GROUP BY ALL) q USING (source, repo) WHERE p.method < q.method AND p.{_IS} AND q.{_IS} GROUP BY ALL) SELECT x.source, x.a, x.b, round(x.delta, 6) + 0 AS delta_pr, round(y.delta, 6) + 0 AS delta_repo, sign(round(x.delta, 6)) <> sign(round(y.delta, 6)) AS flips FROM m x JOIN m y ON x.source = y.source AND x.a = y.a AND x.b = y.b AND x.unit = 'pr' AND y.unit = 'repo'".replace("WITH m AS (", "SELECT * FROM (WITH m AS (").replace("AND y.unit = 'repo'", "AND y.unit = 'repo')"), "pr_rows")
def unit_flips(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orderings whose verdict changes when repositories count instead of pull requests."""
    pr = _made(spark, d, "pr_rows", lambda: _pr_rows(rows(spark, d).where(F.col("method").isin(*RANKED))))
    repo = pr.groupBy("source", "method", "repo").agg(F.avg("auc").alias("auc"))

    def deltas(t: DataFrame, unit: str, name: str) -> DataFrame:
        p, q = t.select("source", unit, F.col("method").alias("a"), F.col("auc").alias("x")), t.select("source", unit, F.col("method").alias("b"), F.col("auc").alias("y"))
        return p.join(q, ["source", unit]).where("a < b").groupBy("source", "a", "b").agg((F.round(F.avg(F.col("x") - F.col("y")), 6) + 0.0).alias(name))

    both = deltas(pr, "pr", "delta_pr").join(deltas(repo, "repo", "delta_repo"), ["source", "a", "b"])
    return both.withColumn("flips", F.sign("delta_pr") != F.sign("delta_repo"))


_WHOLE = "(SELECT task, t.repo, path FROM tasks t JOIN nodes n ON n.repo = t.repo)"
for _n, _tf in (("text", "bags"), ("path", "paths")):
    _PARTS[f"w_{_n}"] = (
        f"""SELECT f.task, f.path, round(coalesce(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * f.len / a))), 0), 9) AS score FROM (SELECT o.task, o.path, coalesce(l.len, 0) AS len FROM {_WHOLE} o LEFT JOIN (SELECT repo, path, sum(tf) AS len FROM {_tf} GROUP BY ALL) l ON l.repo = o.repo AND l.path = o.path WHERE task IN (SELECT task FROM q_none)) f
JOIN (SELECT o.task, count(*) AS n_docs, avg(coalesce(l.len, 0)) AS a FROM {_WHOLE} o LEFT JOIN (SELECT repo, path, sum(tf) AS len FROM {_tf} GROUP BY ALL) l ON l.repo = o.repo AND l.path = o.path GROUP BY ALL) st ON st.task = f.task
LEFT JOIN (SELECT q.task, b.path, b.tf, count(*) OVER (PARTITION BY q.task, b.term) AS df FROM q_none q JOIN {_WHOLE} o ON o.task = q.task JOIN {_tf} b ON b.repo = o.repo AND b.path = o.path AND b.term = q.term) h ON h.task = f.task AND h.path = f.path GROUP BY f.task, f.path""",
        ("tasks", "nodes", _tf, "q_none"),
    )
_PARTS["localised"] = (f"SELECT task, arg_min(path, pos) AS seed FROM (SELECT task, path, {P._POS} FROM (SELECT task, path, sum(1.0::DOUBLE / (60 + pos)) AS score FROM (SELECT task, path, {P._POS} FROM w_text UNION ALL SELECT task, path, {P._POS} FROM w_path) GROUP BY ALL)) GROUP BY task", ("w_text", "w_path"))


@query("SELECT l.task, l.seed, l.seed = t.seed AS guess_correct, regexp_extract(l.seed, '^(.*)/[^/]*$', 1) = regexp_extract(t.seed, '^(.*)/[^/]*$', 1) AS guess_same_dir, split_part(l.seed, '/', 1) = split_part(t.seed, '/', 1) AS guess_same_top FROM tasks t JOIN localised l ON l.task = t.task", "tasks", "localised")
def seed_localiser(spark: SparkSession, d: str) -> DataFrame:
    """The file that the fused lists of the issue put first among all files, beside the task's own seed."""
    t = P.corpus(spark, d).tasks.select("task", F.col("seed").alias("own"))
    x = O.localised(P.corpus(spark, d)).join(t, "task")
    a, b = F.col("seed"), F.col("own")
    return x.select("task", "seed", (a == b).alias("guess_correct"), (T.parent_dir(a) == T.parent_dir(b)).alias("guess_same_dir"), (T.top_dir(a) == T.top_dir(b)).alias("guess_same_top"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN l.seed = t.seed THEN 1.0 ELSE 0 END), 6) AS correct, round(avg(CASE WHEN regexp_extract(l.seed, '^(.*)/[^/]*$', 1) = regexp_extract(t.seed, '^(.*)/[^/]*$', 1) THEN 1.0 ELSE 0 END), 6) AS same_dir FROM tasks t JOIN localised l ON l.task = t.task", "tasks", "localised")
def seedless_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often the guess is right, or at least in the right folder."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return seed_localiser(spark, d).agg(F.count("*").alias("n"), share("guess_correct").alias("correct"), share("guess_same_dir").alias("same_dir"))


#: Numbers of repositories and of tested pairs in the power table.
POWER_N, POWER_M = (12, 20, 30, 40, 60, 80, 120), (1, 20, 100)
_z = NormalDist().inv_cdf


@query(f"SELECT n AS n_repos, m AS pairs_tested, round(0.05 / m, 5) AS alpha_per_test, round((exp(2 * z) - 1) / (exp(2 * z) + 1), 2) AS min_detectable_rho FROM (SELECT n, m, (q + {_z(0.8)!r}) * sqrt(1.06 / (n - 3)) AS z FROM (SELECT unnest({list(POWER_N)}) AS n), (SELECT unnest({list(POWER_M)}) AS m, unnest({[_z(1 - 0.025 / m) for m in POWER_M]}) AS q))".replace("SELECT n AS", "SELECT CAST(n AS INT) AS").replace("m AS pairs", "CAST(m AS INT) AS pairs"))
def power_table(spark: SparkSession, d: str) -> DataFrame:
    """The smallest rank correlation that is found with a power of 0.8, two-sided, for each number of repositories and of pairs."""
    at = spark.createDataFrame([(n, m, _z(1 - 0.025 / m)) for n in POWER_N for m in POWER_M], "n_repos int, pairs_tested int, q double")
    z = (F.col("q") + F.lit(_z(0.8))) * F.sqrt(F.lit(1.06) / (F.col("n_repos") - 3))
    return at.select("n_repos", "pairs_tested", F.round(F.lit(0.05) / F.col("pairs_tested"), 5).alias("alpha_per_test"), F.round(F.tanh(z), 2).alias("min_detectable_rho"))


@query(f"SELECT task, source, CAST(count(*) AS INT) AS key_files, CAST(sum(cost) AS BIGINT) AS key_lines, CAST(any_value(n_nodes) AS BIGINT) AS repo_files FROM ord JOIN about USING (task) WHERE method = 'oracle' GROUP BY ALL", "ord", "about")
def key_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines of each key, and files of its repository."""
    return _best(spark, d).join(_about(spark, d), "task").groupBy("task", "source").agg(F.count("*").cast("int").alias("key_files"), F.sum("cost").alias("key_lines"), F.max("n_nodes").alias("repo_files"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS wanted, CAST(sum(CASE WHEN o.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM (SELECT task, source, path FROM keys UNION SELECT task, 'seed', seed FROM tasks UNION SELECT task, 'gone', seed || 'x' FROM tasks) k LEFT JOIN others o ON o.task = k.task AND o.path = k.path GROUP BY source", "keys", "tasks", "others")
def task_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key files of tasks that are in the graph and not the seed, and how many are dropped; seeds and unknown files all are."""
    c = P.corpus(spark, d)
    wanted = P.keys(spark, d).union(c.tasks.select("task", F.lit("seed"), "seed")).union(c.tasks.select("task", F.lit("gone"), F.concat("seed", F.lit("x"))))
    x = wanted.join(c.others.select("task", "path", F.lit(1).alias("there")), ["task", "path"], "left")
    return x.groupBy("source").agg(F.count("*").alias("wanted"), F.count(F.when(F.col("there").isNull(), 1)).alias("dropped"))


def minimum_detectable(n: int, m: int) -> float:
    """One cell of the power table."""
    return round(math.tanh((_z(1 - 0.025 / m) + _z(0.8)) * math.sqrt(1.06 / (n - 3))), 2)


@query(
    f"""SELECT source, method, round(avg(acc) + 1e-9, 6) AS acc_10, round(avg(share) + 1e-9, 6) AS top_10, round(avg(rr) + 1e-9, 6) AS mrr, round(avg(empty) + 1e-9, 6) AS empty_rate, round((sum(acc) + 0.5) * (any_value(base_miss) + 0.5) / ((count(*) - sum(acc) + 0.5) * (any_value(base_hit) + 0.5)), 6) AS odds_ratio FROM (
  SELECT x.*, sum(CASE WHEN method = 'random' THEN acc ELSE 0 END) OVER (PARTITION BY source) AS base_hit, sum(CASE WHEN method = 'random' THEN 1 - acc ELSE 0 END) OVER (PARTITION BY source) AS base_miss FROM (
    SELECT g.task, g.source, g.method, coalesce(max(CASE WHEN in_key = 1 AND pos <= {TOP} THEN 1.0 END), 0) AS acc, coalesce(sum(CASE WHEN in_key = 1 AND pos <= {TOP} THEN 1.0 END), 0) / any_value(g.key_size) AS share, coalesce(1.0::DOUBLE / min(CASE WHEN in_key = 1 THEN pos END), 0) AS rr, CASE WHEN count(o.pos) = 0 THEN 1.0 ELSE 0.0 END AS empty
    FROM grid g LEFT JOIN ord o ON o.task = g.task AND o.source = g.source AND o.method = g.method GROUP BY g.task, g.source, g.method) x) GROUP BY source, method""",
    "grid",
    "ord",
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether and how much of the key is among the first files, reciprocal ranks, empty lists, and the odds against a random order."""
    hit = F.col("pos") <= TOP
    per = _found(spark, d).groupBy("task", "source", "method").agg(F.max(hit.cast("double")).alias("acc"), F.sum(hit.cast("double")).alias("hits"), (1.0 / F.min("pos")).alias("rr"))
    # An ordering lists all other files of a task or none, so one that has none of the key's files is empty.
    x = _grid(spark, d).join(per, ["task", "source", "method"], "left").withColumn("empty", F.col("acc").isNull().cast("double")).fillna(0.0, ["acc", "hits", "rr"])
    t = x.groupBy("source", "method").agg(F.count("*").alias("n"), F.sum("acc").alias("a"), F.avg("acc").alias("acc_10"), F.avg(F.col("hits") / F.col("key_size")).alias("top_10"), F.avg("rr").alias("mrr"), F.avg("empty").alias("empty_rate"))
    base = t.where("method = 'random'").select("source", F.col("a").alias("b"), (F.col("n") - F.col("a")).alias("c"))
    odds = (F.col("a") + 0.5) * (F.col("c") + 0.5) / ((F.col("n") - F.col("a") + 0.5) * (F.col("b") + 0.5))
    return t.join(F.broadcast(base), "source").select("source", "method", *(_six(F.col(c)).alias(c) for c in ("acc_10", "top_10", "mrr", "empty_rate")), F.round(odds, 6).alias("odds_ratio"))


@query("SELECT o.task, CAST(count(*) AS BIGINT) AS edges, CAST(sum(CASE WHEN a.pos < b.pos THEN 1 ELSE 0 END) AS BIGINT) AS inversions, min(CASE WHEN a.pos < b.pos THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN a.pos < b.pos THEN 1 ELSE 0 END) = 0 AS valid FROM tasks o JOIN edges e ON e.repo = o.repo JOIN o_hops_lines a ON a.task = o.task AND a.path = e.src JOIN o_hops_lines b ON b.task = o.task AND b.path = e.dst GROUP BY o.task", "tasks", "edges", "o_hops_lines")
def ordering_checks(spark: SparkSession, d: str) -> DataFrame:
    """Imports of which the importing file comes first in an order, by task; an order of dependencies has none."""
    c = P.corpus(spark, d)
    o = c.ordering("hops_lines")
    e = c.tasks.select("task", "repo").join(c.edges, "repo")
    x = e.join(o.select("task", F.col("path").alias("src"), F.col("pos").alias("a")), ["task", "src"]).join(o.select("task", F.col("path").alias("dst"), F.col("pos").alias("b")), ["task", "dst"])
    late = F.count(F.when(F.col("a") < F.col("b"), 1))
    return x.groupBy("task").agg(F.count("*").alias("edges"), late.alias("inversions"), (late == 0).alias("valid"))


@query("SELECT n.repo, count(*) AS files, CAST(any_value(coalesce(m.edges, 0)) AS BIGINT) AS edges, round(any_value(coalesce(m.edges, 0)) / (count(*) * (count(*) - 1)), 6) AS density, round(any_value(coalesce(m.edges, 0)) / count(*), 6) AS mean_out, max(coalesce(i.k, 0)) AS max_in, count(*) FILTER (i.k IS NULL) AS roots, count(*) FILTER (o.k IS NULL) AS leaves, round(any_value(coalesce(m.both_ways, 0)) / greatest(any_value(coalesce(m.edges, 0)), 1), 6) AS reciprocity FROM nodes n LEFT JOIN (SELECT repo, dst, count(*) AS k FROM edges GROUP BY ALL) i ON i.repo = n.repo AND i.dst = n.path LEFT JOIN (SELECT repo, src, count(*) AS k FROM edges GROUP BY ALL) o ON o.repo = n.repo AND o.src = n.path LEFT JOIN (SELECT e.repo, count(*) AS edges, count(r.src) AS both_ways FROM edges e LEFT JOIN rev r ON r.repo = e.repo AND r.src = e.src AND r.dst = e.dst GROUP BY ALL) m ON m.repo = n.repo GROUP BY n.repo", "nodes", "edges", "rev")
def structure_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Size, density, degrees, files without imports either way, and reciprocity of each repository's graph."""
    c = P.corpus(spark, d)
    back = c.edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r"))
    m = c.edges.join(back, ["repo", "src", "dst"], "left").groupBy("repo").agg(F.count("*").alias("edges"), F.count("r").alias("both_ways"))
    i = c.edges.groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("i"))
    o = c.edges.groupBy("repo", F.col("src").alias("path")).agg(F.count("*").alias("o"))
    n = c.nodes.join(i, ["repo", "path"], "left").join(o, ["repo", "path"], "left").groupBy("repo").agg(F.count("*").alias("files"), F.max(F.coalesce("i", F.lit(0))).alias("max_in"), F.count(F.when(F.col("i").isNull(), 1)).alias("roots"), F.count(F.when(F.col("o").isNull(), 1)).alias("leaves"))
    x = n.join(m, "repo", "left").fillna(0, ["edges", "both_ways"])
    pairs = F.col("files") * (F.col("files") - 1)
    return x.select("repo", "files", "edges", F.round(F.try_divide(F.col("edges").cast("double"), pairs), 6).alias("density"), F.round(F.col("edges") / F.col("files"), 6).alias("mean_out"), "max_in", "roots", "leaves", F.round(F.col("both_ways") / F.greatest("edges", F.lit(1)), 6).alias("reciprocity"))


@query("SELECT task, kind, arg_min(path, sha256(kind || '|' || task || '|' || path)) AS seed FROM (SELECT h.task, h.path, unnest(list_filter(['any', CASE dist WHEN 1 THEN 'one' WHEN 2 THEN 'two' END], lambda x: x IS NOT NULL)) AS kind FROM hops h) GROUP BY ALL", "hops")
def wrong_seeds(spark: SparkSession, d: str) -> DataFrame:
    """A wrong seed for each task by hash: one hop away, two hops away, or any other file."""
    kinds = F.array_compact(F.array(F.lit("any"), F.when(F.col("dist") == 1, F.lit("one")).when(F.col("dist") == 2, F.lit("two"))))
    x = P.corpus(spark, d).hops().select("task", "path", F.explode(kinds).alias("kind"))
    return x.groupBy("task", "kind").agg(F.min_by("path", T.tie_key(F.col("kind"), F.col("task"), F.col("path"))).alias("seed"))


@query(f"SELECT g.source, g.method, CAST(budget AS INT) AS budget, round(avg(full_) + 1e-9, 6) AS share FROM (SELECT c.source, c.method, c.budget, a.pr, avg(CASE WHEN c.coverage >= 0.999 THEN 1.0 ELSE 0 END) AS full_ FROM curves c JOIN about a ON a.task = c.task GROUP BY ALL) g WHERE {_IS} GROUP BY ALL", "curves", "about")
def full_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of pull requests, as means of their tasks, whose key is read in full within each budget."""
    x = _curves(spark, d).where(F.col("method").isin(*RANKED)).join(_about(spark, d), "task")
    x = x.groupBy("source", "method", "budget", "pr").agg(F.avg((F.col("coverage") >= 0.999).cast("double")).alias("f"))
    return x.groupBy("source", "method", F.col("budget").cast("int").alias("budget")).agg(_six(F.avg("f")).alias("share"))
