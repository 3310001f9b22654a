"""Joins and rules of ingest: priorities, prefixes, as-of, natural joins, repository rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import positions  # noqa: F401
from orrery.staging import stage

#: Folders of code that others wrote, words of generated files' heads, suffixes of code, and the largest file that counts.
VENDORED = ("third-party", "third_party", "vendor", "vendored", "_vendor", "node_modules")
GENERATED = "generated by|do not edit|autogenerated|auto-generated"
CODE = (".py", ".pyx", ".c", ".cc", ".cpp", ".h", ".js", ".ts", ".java", ".go", ".rs")
LARGEST = 2_000_000


def first_by_priority(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order; partial results are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def fill_by_priority(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """One row per key from the first source that has it, its first row by `order`."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    return first_by_priority(rows, [key], ["_source", order]).drop("_source")


def deepest_prefix(rows: DataFrame, name: str, modules: DataFrame, module: str) -> DataFrame:
    """rows with the longest dotted prefix of `name` (itself included) that is a module; null without one."""
    parts = F.split(name, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    found = rows.select(name, F.explode(heads).alias(module)).distinct().join(modules.select(module).distinct(), module)
    best = found.groupBy(name).agg(F.max_by(module, F.length(module)).alias(module))
    return rows.join(best, name, "left")


def natural(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all columns that both have."""
    return a.join(b, [c for c in a.columns if c in b.columns])


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """left with the `value` of right's last row at or before its time in its group (the smallest of equal times), by one sorted pass over both."""
    rest = [c for c in left.columns if c not in (group, at)]
    last = right.groupBy(group, at).agg(F.min(value).alias(value))
    both = left.select(group, at, F.struct(*rest).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_k"))
    both = both.unionByName(last.select(group, at, F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), value, F.lit(0).alias("_k")))
    w = Window.partitionBy(group).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_k = 1").select(group, at, "_l.*", value)


def chase(links: DataFrame) -> DataFrame:
    """links(pkg, name, target) followed to the end: a target that passes the same name on is replaced by what it names.

    One link a round, until none moves. A chain that comes back to itself stops where it closes.
    """
    cur = stage(links.select("pkg", "name", "target", F.array("pkg").alias("seen")), "chase")
    step = links.select(F.col("pkg").alias("target"), "name", F.col("target").alias("further"))
    while True:
        go = cur.join(step, ["target", "name"], "left")
        more = F.col("further").isNotNull() & ~F.array_contains("seen", F.col("target"))
        cur = stage(go.select("pkg", "name", F.when(more, F.col("further")).otherwise(F.col("target")).alias("target"), F.when(more, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"), more.alias("moved")), "chase")
        if cur.where("moved").isEmpty():
            return cur.select("pkg", "name", "target")
        cur = cur.drop("moved")


def file_class(path: Column, head: Column | None = None, size: Column | None = None) -> Column:
    """vendored, generated, code or other: by folder, by the first lines, by suffix; too large files are other."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    code = reduce(lambda a, b: a | b, [path.endswith(s) for s in CODE])
    out = F.when(F.exists(dirs, lambda x: x.isin(*VENDORED)), "vendored")
    if head is not None:
        out = out.when(F.lower(head).rlike(GENERATED), "generated")
    if size is not None:
        out = out.when(size > LARGEST, "other")
    return out.when(code, "code").otherwise("other")


def repo_rules(r: DataFrame) -> DataFrame:
    """Rules over measured repositories (repo, files, share, notebooks, py, generated, packaging, licence, fork); an unknown fork is none."""
    fork = F.coalesce("fork", F.lit(False))
    rules = {
        "r2_share": F.col("share") >= 0.8,
        "r3_files": F.col("files") >= 50,
        "r5_licence": F.col("licence").isNotNull() & (F.col("licence") != "NOASSERTION"),
        "x_fork": fork,
        "x_notebooks": F.col("notebooks") > F.col("py"),
        "x_generated": F.col("generated") > 0.3,
        "flag_monorepo": F.col("packaging") >= 5,
    }
    rules["r5_licence"] = F.coalesce(rules["r5_licence"], F.lit(False))
    passes = reduce(lambda a, b: a & b, [~c if n.startswith("x_") else c for n, c in rules.items() if not n.startswith("flag")])
    return r.select("repo", *(c.alias(n) for n, c in rules.items()), passes.alias("passes"))
