"""Queries on rules, joins and functions of ingest: repository rules, priorities, names, modules and times, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import joins, retrieval
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


@query("""WITH r AS (SELECT c_nationkey AS repo, count(*) AS files, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) AS share, count(*) FILTER (c_mktsegment = 'BUILDING') AS notebooks, count(*) FILTER (c_mktsegment = 'MACHINERY') AS py, avg(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0 END) AS generated, count(*) FILTER (c_acctbal > 9000) AS packaging FROM customer GROUP BY ALL),
g AS (SELECT s_nationkey AS repo, max(CASE WHEN s_acctbal > 8000 THEN 'MIT' END) AS licence, bool_or(s_acctbal < -900) AS fork FROM supplier GROUP BY ALL)
SELECT r.repo, share >= 0.8 AS r2_share, files >= 50 AS r3_files, licence IS NOT NULL AS r5_licence, coalesce(fork, FALSE) AS x_fork, notebooks > py AS x_notebooks, generated > 0.3 AS x_generated, packaging >= 5 AS flag_monorepo,
share >= 0.8 AND files >= 50 AND licence IS NOT NULL AND NOT coalesce(fork, FALSE) AND notebooks <= py AND generated <= 0.3 AS passes FROM r LEFT JOIN g ON g.repo = r.repo""")
def repo_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that a repository must pass: share of its main language, size, licence; no fork, notebooks or generated code in the main."""
    c, seg = S.table(spark, d, "customer"), F.col("c_mktsegment")
    count, share = (lambda cond: F.count(F.when(cond, 1))), (lambda cond: F.avg(cond.cast("double")))
    r = c.groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("files"), share(F.col("c_acctbal") > 0).alias("share"), count(seg == "BUILDING").alias("notebooks"), count(seg == "MACHINERY").alias("py"), share(seg == "FURNITURE").alias("generated"), count(F.col("c_acctbal") > 9000).alias("packaging"))
    g = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("repo")).agg(F.max(F.when(F.col("s_acctbal") > 8000, "MIT")).alias("licence"), F.bool_or(F.col("s_acctbal") < -900).alias("fork"))
    return joins.repo_rules(r.join(g, "repo", "left"))


@query("""WITH t AS (SELECT o_orderkey AS instance, o_custkey % 40 AS repo, 'PR-' || (o_orderkey % 700) AS pr, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS dataset FROM orders),
o AS (SELECT 'one' AS option, 'a' AS dataset, 0 AS prio UNION ALL SELECT * FROM (VALUES ('two', 'a', 0), ('two', 'b', 1), ('all', 'b', 0), ('all', 'a', 1), ('all', 'c', 2))),
k AS (SELECT option, repo, pr, arg_min(instance, (prio, instance)) AS instance FROM t JOIN o USING (dataset) GROUP BY ALL),
p AS (SELECT option, repo, count(*) AS tasks FROM k GROUP BY ALL)
SELECT option, CAST(least_ AS INT) AS least, count(*) FILTER (tasks >= least_) AS repos, CAST(coalesce(sum(tasks) FILTER (tasks >= least_), 0) AS BIGINT) AS tasks, coalesce(median(tasks) FILTER (tasks >= least_), 0) AS median_tasks FROM p, (SELECT unnest([1, 3, 5, 10]) AS least_) GROUP BY ALL""")
def option_table(spark: SparkSession, d: str) -> DataFrame:
    """Repositories and tasks that each choice of collections leaves at each least number of tasks, one task per pull request."""
    pr = F.when(F.col("o_orderpriority") == "1-URGENT", "a").when(F.col("o_orderpriority") == "2-HIGH", "b").otherwise("c")
    t = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("instance"), (F.col("o_custkey") % 40).alias("repo"), F.concat(F.lit("PR-"), (F.col("o_orderkey") % 700).cast("string")).alias("pr"), pr.alias("dataset"))
    options = spark.createDataFrame([("one", "a", 0), ("two", "a", 0), ("two", "b", 1), ("all", "b", 0), ("all", "a", 1), ("all", "c", 2)], "option string, dataset string, prio int")
    tasks = joins.first_by_priority(t.join(F.broadcast(options), "dataset"), ["option", "repo", "pr"], ["prio", "instance"])
    per = tasks.groupBy("option", "repo").agg(F.count("*").alias("tasks"))
    grid = per.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in (1, 3, 5, 10)], "least int")))
    ok = F.when(F.col("tasks") >= F.col("least"), F.col("tasks"))
    return grid.groupBy("option", "least").agg(F.count(ok).alias("repos"), F.coalesce(F.sum(ok), F.lit(0)).alias("tasks"), F.coalesce(F.median(ok), F.lit(0.0)).alias("median_tasks"))


@query("SELECT user_id, arg_min(value, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END, event_id)) AS value, arg_min(event_type, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END, event_id)) AS source FROM events WHERE value > 40 GROUP BY ALL")
def priority_fill(spark: SparkSession, d: str) -> DataFrame:
    """A value for each id from the first source that has one; later sources only fill what is missing."""
    e = S.table(spark, d, "events").where("value > 40")
    source = lambda *kinds: e.where(F.col("event_type").isin(*kinds)).select("user_id", F.col("event_type").alias("source"), "value", "event_id")
    return joins.fill_by_priority([source("purchase"), source("signup"), source("click"), source("view"), source("error")], "user_id", "event_id").select("user_id", "value", "source")


@query("""WITH m AS (SELECT DISTINCT lower(replace(p_type, ' ', '.')) || '.' || string_split(p_name, ' ')[1] AS module FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
w AS (SELECT p_partkey, lower(p_type) || '.' || replace(p_name, ' ', '.') || '.x' AS target FROM part UNION ALL SELECT -p_partkey - 1, 'other.' || p_name FROM part)
SELECT p_partkey, target, arg_max(module, length(module)) AS found FROM w LEFT JOIN m ON target = module OR starts_with(target, module || '.') GROUP BY ALL""")
def closest_module(spark: SparkSession, d: str) -> DataFrame:
    """The deepest module that a dotted name lies in: prefixes are listed and joined by equality."""
    p = S.table(spark, d, "part")
    m = p.select(F.concat_ws(".", F.lower("p_type"), F.split("p_name", " ")[0]).alias("module")).union(p.select(F.lower("p_type"))).distinct()
    w = p.select("p_partkey", F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".x")).alias("target")).union(p.select(-F.col("p_partkey") - 1, F.concat(F.lit("other."), "p_name")))
    return joins.deepest_prefix(w, "target", m, "module").withColumnRenamed("module", "found")


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, min(o_orderpriority) AS first_priority, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS file_group FROM orders GROUP BY ALL")
def any_first_group(spark: SparkSession, d: str) -> DataFrame:
    """Whether any row holds, a value that is the same in all rows, and single or multi."""
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.min("o_orderpriority").alias("first_priority"), F.when(F.count("*") == 1, "single").otherwise("multi").alias("file_group"))


@query("SELECT n_name, r_name, c_custkey, c_acctbal FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT c_custkey, c_acctbal, c_nationkey AS n_nationkey FROM customer) USING (n_nationkey)")
def natural_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tables joined on the columns that both have."""
    n = S.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    c = S.table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.natural(joins.natural(n, S.table(spark, d, "region")), c).select("n_name", "r_name", "c_custkey", "c_acctbal")


@query("SELECT c_mktsegment AS grp, c_custkey, c_acctbal, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def largest_of_group(spark: SparkSession, d: str) -> DataFrame:
    """The five largest of each group (a report of the first few)."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), "c_custkey", "c_acctbal", F.row_number().over(w).alias("place")).where("place <= 5")


_PATHS = "paths AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN '' ELSE 'third-party/' END || lower(p_type) || '/' || replace(p_name, ' ', '_') || CASE p_size % 5 WHEN 0 THEN '/__init__' ELSE '_' || p_partkey END || CASE p_size % 7 WHEN 0 THEN '.pyi' ELSE '.py' END AS path FROM part)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    top = F.when(size % 4 == 0, "src/").when(size % 4 == 1, "tests/").when(size % 4 == 2, "").otherwise("third-party/")
    last = F.when(size % 5 == 0, F.lit("/__init__")).otherwise(F.concat(F.lit("_"), F.col("p_partkey").cast("string")))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(top, F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), last, F.when(size % 7 == 0, ".pyi").otherwise(".py")).alias("path"))


@query(f"""WITH {_PATHS}, x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.', 'g') AS dotted FROM paths)
SELECT k, path, CASE WHEN path LIKE '%.py' AND regexp_full_match(dotted, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') THEN dotted END AS module, regexp_replace(string_split(path, '/')[-1], '\\.py$', '') AS stem, string_split(path, '/')[1] AS top, path LIKE '%.py' AS is_py,
list_has_any(string_split(path, '/')[:-2], ['tests', 'testing']) OR starts_with(string_split(path, '/')[-1], 'test_') AS is_test FROM x""")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    """Module, stem, first folder and kind of each path."""
    p = F.col("path")
    return _paths(spark, d).select("k", "path", T.module_name(p).alias("module"), T.stem(p).alias("stem"), T.top_dir(p).alias("top"), T.is_py(p).alias("is_py"), T.is_test_path(p, ("tests", "testing")).alias("is_test"))


@query(f"""WITH {_PATHS}, x AS (SELECT k, regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/', '.', 'g') AS package, k % 6 AS level, CASE WHEN k % 4 = 0 THEN '' ELSE 'near' END AS module FROM paths)
SELECT k, package, CAST(level AS INT) AS level, module, CASE WHEN level = 0 THEN module WHEN len(string_split(package, '.')) - (level - 1) >= 0 THEN array_to_string(list_filter(list_concat(list_slice(string_split(package, '.'), 1, len(string_split(package, '.')) - (level - 1)), [module]), lambda x: x <> ''), '.') END AS target FROM x""")
def relative_imports(spark: SparkSession, d: str) -> DataFrame:
    """What relative imports of each level name inside a package; null beyond the top."""
    x = _paths(spark, d).select("k", F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), "/", ".").alias("package"), (F.col("k") % 6).cast("int").alias("level"), F.when(F.col("k") % 4 == 0, "").otherwise("near").alias("module"))
    return x.select("*", T.resolve_relative(F.col("package"), F.col("level"), F.col("module")).alias("target"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'own__repo-' || o_orderkey WHEN 1 THEN 'own__repo' ELSE 'Own__Repo-x' || o_orderkey END AS instance, CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch_ms(o_orderdate) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'soon' END AS created, CASE o_orderkey % 3 WHEN 0 THEN 'swegym' WHEN 1 THEN 'swebench_live_full' ELSE 'other' END AS dataset FROM orders)
SELECT o_orderkey, try_cast(nullif(regexp_extract(instance, '-([0-9]+)$', 1), '') AS BIGINT)::DOUBLE AS pr, CASE WHEN regexp_full_match(created, '[0-9]+') THEN epoch_ms(try_cast(created AS BIGINT)) ELSE try_cast(created AS TIMESTAMP) END AS at,
regexp_replace(CASE dataset WHEN 'swegym' THEN 'xingyaoww/sweb.eval.x86_64.' || replace(lower(instance), '__', '_s_') WHEN 'swebench_live_full' THEN 'starryzhang/sweb.eval.x86_64.' || replace(lower(instance), '__', '_1776_') ELSE 'own/' || instance || ':latest' END, ':latest$', '') AS image FROM x""")
def instance_fields(spark: SparkSession, d: str) -> DataFrame:
    """Pull request, time and image of an instance from its id and fields."""
    k = F.col("o_orderkey")
    o = S.table(spark, d, "orders")
    instance = F.when(k % 3 == 0, F.concat(F.lit("own__repo-"), k.cast("string"))).when(k % 3 == 1, "own__repo").otherwise(F.concat(F.lit("Own__Repo-x"), k.cast("string")))
    created = F.when(k % 4 == 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 2, "soon")
    dataset = F.when(k % 3 == 0, "swegym").when(k % 3 == 1, "swebench_live_full").otherwise("other")
    x = o.select("o_orderkey", instance.alias("instance"), created.alias("created"), dataset.alias("dataset"))
    own = F.concat(F.lit("own/"), F.col("instance"), F.lit(":latest"))
    return x.select("o_orderkey", T.pr_number(F.col("instance")).cast("double").alias("pr"), T.to_time(F.col("created")).cast("timestamp_ntz").alias("at"), T.image_name(F.col("dataset"), F.col("instance"), own, F.lit(None).cast("string")).alias("image"))


@query("SELECT DISTINCT ident, CASE WHEN length(ident) >= 8 AND (contains(ident, '_') OR regexp_matches(ident, '^.+[A-Z]')) THEN 10.0 ELSE 1.0 END * CASE WHEN starts_with(ident, '_') THEN 0.1 ELSE 1.0 END AS weight FROM (SELECT unnest(regexp_extract_all(text || ' ' || replace(lower(text), ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM benchmark)")
def identifier_weights(spark: SparkSession, d: str) -> DataFrame:
    """How much a name counts as a reference."""
    t = F.concat("text", F.lit(" "), F.replace(F.lower("text"), F.lit(" "), F.lit("_")))
    names = S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(t, F.lit(T.IDENTIFIER), F.lit(0))).alias("ident")).distinct()
    return names.select("ident", T.identifier_weight(F.col("ident")).alias("weight"))


@query(f"""WITH {_PATHS}, s AS (SELECT string_split(path, '/')[:-2] AS sd FROM paths WHERE k = (SELECT min(k) FROM paths)), x AS (SELECT k, path, string_split(path, '/')[:-2] AS pd, sd FROM paths, s),
y AS (SELECT k, path, pd, sd, coalesce(list_position(list_transform(range(1, CAST(least(len(pd), len(sd)) AS BIGINT) + 1), lambda i: pd[i] <> sd[i]), TRUE) - 1, least(len(pd), len(sd))) AS same FROM x)
SELECT k, CAST(len(pd) + len(sd) - 2 * same AS INT) AS steps, CAST(row_number() OVER (ORDER BY len(pd) + len(sd) - 2 * same, sha256('seed|' || path), k) AS INT) AS pos FROM y""")
def directory_order(spark: SparkSession, d: str) -> DataFrame:
    """All files by the steps between their folder and the first file's."""
    p = _paths(spark, d)
    seed = F.broadcast(p.agg(F.min_by("path", "k").alias("seed")))
    x = p.crossJoin(seed).select("k", "path", T.folder_distance(F.col("path"), F.col("seed")).cast("int").alias("steps"))
    return joins.positions(x, [F.col("steps"), T.tie_key(F.lit("seed"), F.col("path")), F.col("k")]).select("k", "steps", F.col("pos").cast("int").alias("pos"))


@query(f"""WITH {_PATHS}, f AS (SELECT k, path, string_split(path, '/')[:-2] AS dirs FROM paths)
SELECT string_split(path, '/')[1] AS top, count(*) AS files, count(*) FILTER (list_has_any(dirs, ['third-party', 'vendor', 'vendored', '_vendor', 'third_party', 'node_modules'])) AS vendored, count(*) FILTER (path LIKE '%.py') AS py, count(*) FILTER (path LIKE '%.py' AND NOT list_has_any(dirs, ['test', 'tests', 'testing']) AND NOT starts_with(string_split(path, '/')[-1], 'test_')) AS nontest FROM f GROUP BY ALL""")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Files of each kind by first folder."""
    p = F.col("path")
    cls = joins.file_class(p)
    count = lambda c: F.count(F.when(c, 1))
    return _paths(spark, d).groupBy(T.top_dir(p).alias("top")).agg(F.count("*").alias("files"), count(cls == "vendored").alias("vendored"), count(T.is_py(p)).alias("py"), count(T.is_py(p) & ~T.is_test_path(p)).alias("nontest"))


@query("SELECT label, CAST(i - 1 AS INT) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, sum(e * w) / sum(w) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS e, unnest(range(1, len(embedding) + 1)) AS i, 1 + vec_id % 7 AS w FROM embeddings) GROUP BY ALL)")
def weighted_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of a text's chunks, weighed by their lengths, scaled to length 1: one row per component."""
    e = S.table(spark, d, "embeddings").select("label", F.col("embedding").alias("v"), (1 + F.col("vec_id") % 7).alias("w"))
    return retrieval.mean_vectors(e, "label").select("label", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("SELECT conv_id, text FROM (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, role, text) AS r FROM conversations c WHERE trim(coalesce(text, '')) <> '' AND c.conv_id IN (SELECT doc_id FROM labels)) WHERE r = 1")
def wanted_statements(spark: SparkSession, d: str) -> DataFrame:
    """The first statement that is not blank of each wanted id."""
    wanted = S.table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return S.first_nonblank(S.table(spark, d, "conversations").join(wanted, "conv_id", "left_semi"), "conv_id", "text", ["turn", "role", "text"]).select("conv_id", "text")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_name AS pkg, 'x' || (n_nationkey % 5) AS name, 'NATION_' || (n_nationkey + 5) AS target FROM nation), f AS (SELECT pkg, name, target, 0 AS d FROM e UNION SELECT f.pkg, f.name, e.target, d + 1 FROM f JOIN e ON e.pkg = f.target AND e.name = f.name WHERE d < 40)
SELECT pkg, name, arg_max(target, d) AS target FROM f GROUP BY ALL""")
def reexports(spark: SparkSession, d: str) -> DataFrame:
    """Names that packages pass on, followed to where they come from."""
    n = S.table(spark, d, "nation")
    e = n.select(F.col("n_name").alias("pkg"), F.concat(F.lit("x"), (F.col("n_nationkey") % 5).cast("string")).alias("name"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") + 5).cast("string")).alias("target")).distinct()
    return joins.chase(e)


@query("WITH b AS (SELECT l_orderkey AS sha, l_partkey AS path, l_suppkey AS blob FROM lineitem), t AS (SELECT s_suppkey AS blob, s_name AS content, s_acctbal AS lines FROM supplier WHERE s_acctbal > 0) SELECT sha, path, coalesce(content, '') AS content, greatest(coalesce(lines, 0), 1) AS cost FROM (SELECT sha, path, min(blob) AS blob FROM b GROUP BY ALL) LEFT JOIN t USING (blob)")
def blob_join(spark: SparkSession, d: str) -> DataFrame:
    """Files of commits with the content of their blobs, each blob kept once; files without one are empty and cost 1."""
    b = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).agg(F.min("l_suppkey").alias("blob"))
    t = S.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("blob"), F.col("s_name").alias("content"), F.col("s_acctbal").alias("lines"))
    return b.join(t, "blob", "left").select("sha", "path", F.coalesce("content", F.lit("")).alias("content"), F.greatest(F.coalesce("lines", F.lit(0.0)), F.lit(1.0)).alias("cost"))


@query("SELECT c_custkey, count(*) AS before_n, CAST(max(o_orderdate) AS TIMESTAMP) AS last_before FROM orders JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS base FROM orders GROUP BY ALL) ON o_custkey = c_custkey WHERE o_orderdate < base GROUP BY ALL")
def history_before(spark: SparkSession, d: str) -> DataFrame:
    """History strictly before each group's latest time."""
    o = S.table(spark, d, "orders")
    base = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("base"))
    return o.join(base, "o_custkey").where("o_orderdate < base").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("before_n"), F.max("o_orderdate").alias("last_before"))


@query("""WITH q AS (SELECT s.s_suppkey, s.s_nationkey, s.s_acctbal FROM supplier s) SELECT s_suppkey, arg_max(c_custkey, (c_acctbal, -c_custkey))::DOUBLE AS nearest FROM q LEFT JOIN customer c ON c.c_nationkey = s_nationkey AND c_acctbal <= s_acctbal GROUP BY ALL""")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each row the other table's last row at or before it in its group: one sorted pass, no inequality join."""
    left = S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("at"), "s_suppkey")
    right = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("at"), "c_custkey")
    return joins.as_of(left, right, "g", "at", "c_custkey").select("s_suppkey", F.col("c_custkey").cast("double").alias("nearest"))
