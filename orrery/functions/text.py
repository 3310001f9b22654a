"""Tokens, bags and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers, and the parts of an identifier between underscores.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SUBTOKEN = r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"
#: Names that are one subtoken as they stand, as most words are.
_PLAIN = "^[A-Z]?[a-z0-9]+$"


def split_ident(name: Column) -> Column:
    """Lower-case parts, of two letters at least, of snake_case and camelCase names."""
    plain = F.when(F.length(name) >= 2, F.array(F.lower(name))).otherwise(F.array().cast("array<string>"))
    return F.when(name.rlike(_PLAIN), plain).otherwise(_split(name))


def _split(name: Column) -> Column:
    parts = F.flatten(F.transform(F.split(name, "_"), lambda p: F.regexp_extract_all(p, F.lit(SUBTOKEN), F.lit(0))))
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 2)


def bag_tokens(text: Column) -> Column:
    """All subtokens of all identifiers of a text, with repeats; null counts as empty."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.flatten(F.transform(names, split_ident))


def path_tokens(path: Column) -> Column:
    words = F.filter(F.split(F.coalesce(path, F.lit("")), "[^A-Za-z0-9_]+"), lambda w: w != "")
    return F.flatten(F.transform(words, split_ident))


def bag(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)."""
    return rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def text_bag(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf) of the subtokens of all identifiers of a text: each name is counted in its text, then split once."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    counted = rows.select(key, F.explode(names).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))
    return counted.select(key, F.explode(split_ident(F.col("name"))).alias("term"), "n").groupBy(key, "term").agg(F.sum("n").alias("tf"))


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without one; 0 for empty and null texts."""
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without folder and .py."""
    return F.regexp_replace(base_name(path), r"\.py$", "")


def top_dir(path: Column) -> Column:
    """The first folder of a path; null for files of the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def is_py(path: Column) -> Column:
    return path.endswith(".py")


def module_name(path: Column) -> Column:
    """The dotted name of a Python file, __init__ standing for its folder; null where a part is no (ASCII) identifier."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    return F.when(is_py(path) & dotted.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"), dotted)


def resolve_relative(package: Column, level: Column, module: Column) -> Column:
    """What `from ..module import x` names inside a package: one level is the package itself; null beyond the top."""
    parts = F.filter(F.split(F.coalesce(package, F.lit("")), r"\."), lambda x: x != "")
    up = F.size(parts) - (level - 1)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(up, F.lit(0))), ".")
    whole = F.concat_ws(".", F.when(base != "", base), F.when(F.coalesce(module, F.lit("")) != "", module))
    return F.when(level <= 0, module).when(up >= 0, whole)


def pr_number(instance: Column) -> Column:
    """The digits behind the last hyphen of an id; null without them."""
    return F.regexp_extract(instance, r"-(\d+)$", 1).try_cast("long")


def to_time(value: Column) -> Column:
    """A time from milliseconds since 1970 written in digits, or from an ISO form; null from anything else."""
    digits = value.rlike(r"^\d+$")
    return F.when(digits, F.timestamp_millis(F.when(digits, value).cast("long"))).otherwise(F.try_to_timestamp(F.when(~digits, value)))


def identifier_weight(name: Column) -> Column:
    """Ten for a long composed name, a tenth for a private one, one for others; the two multiply."""
    long = (F.length(name) >= 8) & (F.instr(name, "_") > 0) | (F.length(name) >= 8) & name.rlike("^.+[A-Z]")
    return F.when(long, 10.0).otherwise(1.0) * F.when(name.startswith("_"), 0.1).otherwise(1.0)


#: Where each collection keeps the environments of its tasks, and what stands for a double underscore there.
IMAGES = {"swegym": ("xingyaoww/sweb.eval.x86_64.", "_s_"), "swebench_live_full": ("starryzhang/sweb.eval.x86_64.", "_1776_")}
TAGGED = {"swebench_pro": "jefzda/sweap-images:"}


def image_name(dataset: Column, instance: Column, image: Column, tag: Column) -> Column:
    """The image of a task's environment, by its collection's rule; collections without one name it themselves. No :latest."""
    name = image
    for kind, (prefix, joint) in IMAGES.items():
        name = F.when(dataset == kind, F.concat(F.lit(prefix), F.replace(F.lower(instance), F.lit("__"), F.lit(joint)))).otherwise(name)
    for kind, prefix in TAGGED.items():
        name = F.when(dataset == kind, F.concat(F.lit(prefix), tag)).otherwise(name)
    return F.regexp_replace(name, ":latest$", "")


def folder_distance(a: Column, b: Column) -> Column:
    """Steps up and down between the folders of two paths."""
    x, y = (F.filter(F.split(parent_dir(p), "/"), lambda s: s != "") for p in (a, b))
    n = F.least(F.size(x), F.size(y))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda acc, i: F.when((acc == i) & (i < n) & (F.get(x, i) == F.get(y, i)), acc + 1).otherwise(acc))
    return F.size(x) + F.size(y) - 2 * same


def is_test_path(path: Column, folders: tuple[str, ...] = ("test", "tests", "testing")) -> Column:
    """Folders of these names (the older rule has no test/), files test_*, *_test.py and conftest.py."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    name = base_name(path)
    return F.exists(dirs, lambda d: d.isin(*folders)) | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def tie_key(*parts: Column) -> Column:
    """The hash that orders equal scores; the same in every run and engine."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
