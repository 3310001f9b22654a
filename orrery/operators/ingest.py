"""From sources, patches and issues to graphs, tasks and keys, as joins over tables.

files(repo, path, text); import records come from functions.code.import_records.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import code
from orrery.functions import text as T
from orrery.operators import joins

STDLIB = sorted(sys.stdlib_module_names)


@dataclass(frozen=True)
class Options:
    """What counts as an edge; the defaults are those of plain import statements."""

    parent_inits: bool = False
    defining: bool = False
    weighted: bool = False
    include_tests: bool = True
    type_checking: bool = True
    function_level: bool = True


def discovered(files: DataFrame, include_tests: bool = True) -> DataFrame:
    """(repo, path, module, reason): the module each Python file is, or why it is none.

    Files below src/ are named from there where src/ holds a folder or a module. Of files with
    one name the first path is the module, the others are duplicates.
    """
    f = files.where(T.is_py(F.col("path"))).select("repo", "path").distinct()
    inner = f.where("path LIKE 'src/%'").select("repo").distinct().withColumn("_src", F.lit(True))
    f = f.join(F.broadcast(inner), "repo", "left")
    p = F.col("path")
    below = F.when(F.col("_src") & p.startswith("src/"), F.substring(p, 5, 2**31 - 1)).otherwise(p)
    own = f.select("repo", "path", T.module_name(below).alias("module"), (below == "__init__.py").alias("_root"))
    reason = F.when(F.exists(F.split(p, "/"), lambda x: x.startswith(".")), "hidden").when(T.is_test_path(p) if not include_tests else F.lit(False), "test").when(F.col("_root"), "root").when(F.col("module").isNull(), "no identifier")
    own = own.withColumn("reason", reason)
    first = own.where("reason IS NULL").groupBy("repo", "module").agg(F.min("path").alias("_first"))
    own = own.join(first, ["repo", "module"], "left")
    return own.select("repo", "path", F.when(F.col("reason").isNull() & (p == F.col("_first")), F.col("module")).alias("module"), F.coalesce("reason", F.when(p != F.col("_first"), "duplicate")).alias("reason"))


def statements(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path, module, ok, lineno, target, names, ...): import statements of modules, one row each."""
    m = modules.where("module IS NOT NULL").select("repo", "path", F.col("module").alias("own"))
    r = files.join(m, ["repo", "path"]).select("repo", "path", "own", code.import_records(F.col("text")).alias("x"))
    return r.select("repo", "path", "own", "x.ok", F.explode("x.records").alias("r")).select("repo", "path", "own", "ok", "r.*")


def construct_counts(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, construct, n)."""
    m = modules.where("module IS NOT NULL").select("repo", "path")
    r = files.join(m, ["repo", "path"], "left_semi").select("repo", F.explode(code.import_records(F.col("text"))["counts"]).alias("construct", "n"))
    return r.groupBy("repo", "construct").agg(F.sum("n").alias("n"))


def _package(own: str, path: str):
    return F.when(F.col(path).endswith("__init__.py"), F.col(own)).otherwise(F.when(F.instr(own, ".") > 0, F.regexp_extract(own, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit("")))


def resolved(records: DataFrame, modules: DataFrame, options: Options = Options()) -> DataFrame:
    """(repo, path, lineno, target, module, reason): what each imported name leads to.

    module is null where nothing of the repository was found; reason is then 'stdlib',
    'third party', 'beyond top' or 'not found'. `import a.b.c` leads to the deepest module
    there is (reason 'partly' if that is not the whole), `from a import b` to a.b or else to a.
    """
    m = modules.where("module IS NOT NULL").select("repo", "module")
    r = records
    if not options.type_checking:
        r = r.where("NOT in_type_checking")
    if not options.function_level:
        r = r.where("NOT in_function")
    r = r.withColumn("base", F.when(F.col("level") > 0, T.resolve_relative(_package("own", "path"), F.col("level"), F.col("module"))).otherwise(F.col("module"))).drop("module")
    tops = m.select("repo", F.substring_index("module", ".", 1).alias("_top")).distinct().withColumn("_in", F.lit(True))
    r = r.withColumn("_top", F.substring_index("base", ".", 1)).join(tops, ["repo", "_top"], "left")
    outside = F.when(F.col("base").isNull(), "beyond top").when((F.col("level") == 0) & F.col("_in").isNull(), F.when(F.col("_top").isin(*STDLIB), "stdlib").otherwise("third party"))
    r = r.withColumn("reason", outside)
    gone = r.where("reason IS NOT NULL").select("repo", "path", "lineno", F.col("base").alias("target"), F.lit(None).cast("string").alias("module"), "reason")
    live = r.where("reason IS NULL").select("repo", "path", "lineno", "base", "names")
    plain = F.size("names") == 0
    star = F.array_contains("names", "*")
    # Whole statements: deepest module for a plain import, the module itself for a star.
    whole = live.where(plain).select("repo", "path", "lineno", F.concat_ws(":", "repo", "base").alias("at"))
    known = m.select(F.concat_ws(":", "repo", "module").alias("module"))
    deep = joins.deepest_prefix(whole.withColumn("name", F.col("at")), "at", known, "module")
    deep = deep.select("repo", "path", "lineno", F.regexp_replace("at", "^[^:]*:", "").alias("target"), F.regexp_replace("module", "^[^:]*:", "").alias("module"))
    starred = live.where(star).select("repo", "path", "lineno", F.col("base").alias("target")).join(m.withColumn("target", F.col("module")), ["repo", "target"], "left").select("repo", "path", "lineno", "target", "module")
    named = live.where(~plain & ~star).select("repo", "path", "lineno", "base", F.explode("names").alias("name")).withColumn("target", F.when(F.col("base") == "", F.col("name")).otherwise(F.concat_ws(".", "base", "name")))
    sub, own = m.select("repo", F.col("module").alias("target"), F.col("module").alias("_sub")), m.select("repo", F.col("module").alias("base"), F.col("module").alias("_own"))
    named = named.join(sub, ["repo", "target"], "left").join(own, ["repo", "base"], "left")
    if options.defining:
        via = reexported(records, modules).select("repo", F.col("pkg").alias("base"), "name", F.col("target").alias("_via"))
        named = named.join(via, ["repo", "base", "name"], "left").withColumn("_own", F.when(F.col("_own").isNotNull(), F.coalesce("_via", "_own")))
    named = named.select("repo", "path", "lineno", "target", F.coalesce("_sub", "_own").alias("module"))
    found = deep.unionByName(starred).unionByName(named)
    partly = F.when(F.col("module").isNull(), "not found")
    out = found.withColumn("reason", partly)
    deep_key = deep.where("module IS NOT NULL AND module <> target").select("repo", "path", "lineno", "target").distinct().withColumn("_p", F.lit("partly"))
    out = out.join(deep_key, ["repo", "path", "lineno", "target"], "left").withColumn("reason", F.coalesce("reason", "_p")).drop("_p")
    return out.unionByName(gone)


def reexported(records: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, pkg, name, target): names that packages import at the top of their __init__, followed to the module they come from."""
    m = modules.where("module IS NOT NULL").select("repo", "path", "module")
    top = records.where("top AND size(names) > 0 AND path LIKE '%__init__.py'")
    base = F.when(F.col("level") > 0, T.resolve_relative(F.col("own"), F.col("level"), F.col("module"))).otherwise(F.col("module"))
    x = top.select("repo", F.col("own").alias("pkg"), base.alias("base"), F.explode(F.arrays_zip("names", "aliases")).alias("n")).select("repo", "pkg", "base", F.col("n.names").alias("orig"), F.col("n.aliases").alias("name")).where("orig <> '*'")
    known = m.select("repo", F.col("module").alias("base"))
    x = x.join(known, ["repo", "base"]).withColumn("sub", F.concat_ws(".", "base", "orig")).join(m.select("repo", F.col("module").alias("sub"), F.lit(True).alias("_is")), ["repo", "sub"], "left")
    direct = x.select("repo", "pkg", "name", F.when(F.col("_is"), F.col("sub")).otherwise(F.col("base")).alias("target"))
    mark = lambda c: F.concat_ws(":", "repo", c)
    ends = joins.chase(direct.select(mark("pkg").alias("pkg"), "name", mark("target").alias("target")).dropDuplicates(["pkg", "name"]))
    bare = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    return ends.select(F.substring_index("pkg", ":", 1).alias("repo"), bare("pkg").alias("pkg"), "name", bare("target").alias("target"))


def import_edges(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(repo, src, dst, weight): files that import files; weight is the number of statements' names if options.weighted, else 1."""
    modules = discovered(files, options.include_tests)
    m = modules.where("module IS NOT NULL").select("repo", "module", F.col("path").alias("dst"))
    r = resolved(statements(files, modules), modules, options).where("module IS NOT NULL")
    hits = r.select("repo", "path", "lineno", "target", "module")
    if options.parent_inits:
        parts = F.split("module", r"\.")
        up = hits.select("repo", "path", "lineno", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("module")).distinct()
        own = hits.select("repo", "path", "lineno", "module").distinct()
        hits = hits.select("repo", "path", "lineno", "module").unionByName(up.join(own, ["repo", "path", "lineno", "module"], "left_anti"))
    e = hits.join(m, ["repo", "module"]).where("path <> dst").groupBy("repo", F.col("path").alias("src"), "dst").agg(F.count("*").alias("weight"))
    return e if options.weighted else e.withColumn("weight", F.lit(1).cast("long"))


def edge_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(repo, both, only_a, only_b, jaccard) of two builders' edges."""
    x = a.select("repo", "src", "dst").distinct().withColumn("_a", F.lit(1)).join(b.select("repo", "src", "dst").distinct().withColumn("_b", F.lit(1)), ["repo", "src", "dst"], "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return x.groupBy("repo").agg(both.alias("both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"), (both / F.count("*")).alias("jaccard"))


def task_rows(patches: DataFrame) -> DataFrame:
    """patches(instance, repo, patch) with what the patch does: changed, new and deleted source files, tests aside, and changed lines."""
    x = patches.select("*", F.explode_outer(code.diff_changes(F.col("patch"))).alias("c"))
    path = F.coalesce("c.new_path", "c.old_path")
    source = T.is_py(path) & ~T.is_test_path(path)
    there, gone = F.col("c.old_path").isNotNull() & F.col("c.new_path").isNotNull(), F.col("c.new_path").isNull()
    files = lambda cond: F.array_sort(F.collect_set(F.when(source & cond, path)))
    lines = F.sum(F.when(source, F.col("c.added") + F.col("c.removed")).otherwise(0))
    out = x.groupBy("instance", "repo").agg(files(there).alias("edited"), files(F.col("c.old_path").isNull()).alias("new_files"), files(gone).alias("deleted"), lines.alias("changed_lines"))
    n = F.size("edited")
    return out.withColumn("file_group", F.when(n == 1, "single").when(n > 1, "multi"))


def tasks(rows: DataFrame, symbol: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, instance, repo, seed, source, path, in_graph): one task for each edited file, the others its co-edited key.

    symbol(instance, path) is the other key. Key files outside nodes(repo, path) are kept with in_graph false; the seed is no key.
    """
    e = rows.select("instance", "repo", F.explode("edited").alias("seed"))
    e = e.join(nodes.select("repo", F.col("path").alias("seed")), ["repo", "seed"], "left_semi").withColumn("task", F.concat_ws("::", "instance", "seed"))
    edited = e.join(rows.select("instance", F.explode("edited").alias("path")), "instance").withColumn("source", F.lit("co_edited"))
    defined = e.join(symbol.select("instance", "path").distinct(), "instance").withColumn("source", F.lit("symbol"))
    keys = edited.unionByName(defined.select(edited.columns)).where("path <> seed")
    known = nodes.select("repo", "path").distinct().withColumn("_in", F.lit(True))
    return keys.join(known, ["repo", "path"], "left").select("task", "instance", "repo", "seed", "source", "path", F.coalesce("_in", F.lit(False)).alias("in_graph"))


def symbol_key(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(instance, path, name): files of the repository that define a name on a patch's added source lines; new files and tests aside.

    Names are matched with definitions, without type inference: a name with several definers counts for each.
    """
    x = patches.select("instance", "repo", F.explode(code.diff_changes(F.col("patch"))).alias("c"))
    path = F.coalesce("c.new_path", "c.old_path")
    lines = x.where(T.is_py(path) & ~T.is_test_path(path)).select("instance", "repo", F.explode("c.added_lines").alias("line"))
    names = lines.select("instance", "repo", F.explode(F.regexp_extract_all("line", F.lit(T.IDENTIFIER), F.lit(0))).alias("name")).distinct()
    defs = files.where(T.is_py(F.col("path")) & ~T.is_test_path(F.col("path"))).select("repo", "path", F.explode(code.source_names(F.col("text"))).alias("name"))
    new = x.where("c.old_path IS NULL").select("instance", F.col("c.new_path").alias("path"))
    return names.join(defs, ["repo", "name"]).join(new, ["instance", "path"], "left_anti").select("instance", "path", "name").distinct()


def gold_key(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, source, path) from rows(task, repo, seed, files, edited): files is a JSON list of read files.

    'gold' are its Python files in the graph without the seed, 'gold_readonly' those that are not edited either.
    """
    x = rows.select("task", "repo", "seed", "edited", F.explode(F.from_json("files", "array<string>")).alias("path")).where("path <> seed AND path LIKE '%.py'").distinct()
    x = x.join(nodes.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    gold = x.select("task", F.lit("gold").alias("source"), "path")
    return gold.union(x.where(~F.array_contains("edited", F.col("path"))).select("task", F.lit("gold_readonly"), "path")).distinct()
