"""Sources, patches and issues on small hand-made repositories, and the joins that make graphs, tasks and keys of them."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import code
from orrery.operators import ingest, joins

PATCH = """diff --git a/shop/cart.py b/shop/cart.py
index 1..2 100644
--- a/shop/cart.py
+++ b/shop/cart.py
@@ -3,3 +3,4 @@ class Cart:
 keep
-old
+total = price(item)
+rest
 keep
@@ -40 +41 @@
-x
+y
\\ No newline at end of file
diff --git a/shop/fresh.py b/shop/fresh.py
new file mode 100644
--- /dev/null
+++ b/shop/fresh.py
@@ -0,0 +1,2 @@
+def made():
+    pass
diff --git a/shop/gone.py b/shop/gone.py
deleted file mode 100644
--- a/shop/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/notes.md b/notes.md
--- a/notes.md
+++ b/notes.md
@@ -1,2 +1,2 @@
---- a/looks like a head
++++ b/looks like a head
 diff --git a/in b/hunk
diff --git a/shop/a.py b/shop/b.py
similarity index 100%
rename from shop/a.py
rename to shop/b.py
"""

REPO = {
    "shop/__init__.py": "from .cart import Cart as Basket\nfrom .deep import thing\n__all__ = ['Basket']\n",
    "shop/cart.py": "import os, sys\nimport numpy as np\nfrom . import money\nfrom .money import price, unknown\nimport shop.deep.core.missing\n",
    "shop/money.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from shop import cart\ntry:\n    import shop.deep\nexcept ImportError:\n    pass\n\ndef price(x):\n    from .deep.core import thing\n    return thing(x)\n",
    "shop/deep/__init__.py": "from .core import thing\n",
    "shop/deep/core.py": "from ...beyond import a\nfrom .... import b\nfrom shop.deep.core import thing\ndef thing(): pass\n",
    "shop/broken.py": "def f(:\nimport shop.money\nfrom shop import cart\n",
    "tool.py": "from shop import *\nfrom shop import Basket\nimport importlib\nimportlib.import_module('x')\n",
    "tests/test_cart.py": "from shop.cart import Cart\n",
    "docs/my-file.py": "import shop\n",
    ".hidden/x.py": "import shop\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", p, t) for p, t in REPO.items()] + [("other", "shop/cart.py", "import shop.money\n"), ("other", "x.txt", "import shop")], "repo string, path string, text string")


def test_changes():
    got = code.changes(PATCH)
    assert [(c.old_path, c.new_path, c.added, c.removed) for c in got] == [("shop/cart.py", "shop/cart.py", 3, 2), (None, "shop/fresh.py", 2, 0), ("shop/gone.py", None, 0, 1), ("notes.md", "notes.md", 1, 1), ("shop/a.py", "shop/b.py", 0, 0)]
    assert got[0].added_linenos == [4, 5, 41] and got[0].added_lines == ["total = price(item)", "rest", "y"] and got[3].added_lines == ["+++ b/looks like a head"]
    assert code.changes(None) == code.changes("") == code.changes("@@ -1 +1 @@\n+x") == []


def test_changes_against_difflib():
    import difflib

    r = random.Random(2)
    for _ in range(200):
        a = [f"{r.choice('abc')}{r.choice(['', '--- x', '+++ y', '@@ -1 +1 @@'])}\n" for _ in range(r.randint(0, 30))]
        b = [x for x in a if r.random() > 0.2]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice(["new\n", "++ z\n", "diff --git a/q b/q\n"]))
        diff = "diff --git a/f b/f\n" + "".join(difflib.unified_diff(a, b, "a/f", "b/f", n=2))
        (c,) = code.changes(diff)
        assert [b[n - 1] for n in c.added_linenos] == [x + "\n" for x in c.added_lines] and len(a) - c.removed + c.added == len(b)


def test_names_and_features():
    assert code.names_on("if total == price(item):") == [(3, "total"), (12, "price"), (18, "item")] and code.names_on("'''open") == []
    f = code.features("import os\nLIMIT: int = 3\nclass Cart(Base):\n    def add_item(self):\n        return os.getcwd(self.lastItem)\n")
    assert (f["lines"], f["parse_ok"], f["defs"], f["calls"]) == (5, True, ["Cart", "LIMIT", "add_item"], ["getcwd"])
    assert f["refs"] == ["Base", "LIMIT", "getcwd", "int", "lastItem", "os", "self"] and f["bag"]["item"] == 2 and f["bag"]["last"] == 1
    bad = code.features("def (:\n HTTPServer")
    assert not bad["parse_ok"] and bad["bag"] == {"def": 1, "http": 1, "server": 1} and bad["defs"] == []
    assert code.defined_names("class Big:\n    def go(self): pass\n    def run_it(self): pass\n    def __init__(self): pass\n") == {"Big", "run_it"} and code.defined_names("(") == set()
    assert code.features(None)["lines"] == 0


def test_imports():
    found, counts, ok = code.imports(REPO["shop/money.py"])
    assert ok and [(i.lineno, i.module, i.in_type_checking, i.in_try, i.in_function) for i in found] == [(1, "typing", False, False, False), (3, "shop", True, False, False), (5, "shop.deep", False, True, False), (10, "deep.core", False, False, True)]
    assert code.imports(REPO["tool.py"])[1] == {"from_import": 2, "star": 1, "import": 1, "importlib_import_module": 1} | {k: 0 for k in code.imports(REPO["tool.py"])[1] if not code.imports(REPO["tool.py"])[1][k]}
    found, counts, ok = code.imports(REPO["shop/broken.py"])
    assert not ok and counts["parse_failure"] == 1 and [(i.module, i.names) for i in found] == [("shop.money", ()), ("shop", ("cart",))]


def test_discovery_and_edges(spark, files):
    m = {(r.repo, r.path): (r.module, r.reason) for r in ingest.discovered(files).collect()}
    assert m["r", "shop/__init__.py"] == ("shop", None) and m["r", "shop/deep/core.py"][0] == "shop.deep.core" and m["r", "docs/my-file.py"] == (None, "no identifier") and m["r", ".hidden/x.py"] == (None, "hidden") and m["other", "shop/cart.py"][0] == "shop.cart"
    edges = lambda o=ingest.Options(): {(r.src, r.dst) for r in ingest.import_edges(files, o).where("repo = 'r'").collect()}
    plain = {("shop/__init__.py", "shop/cart.py"), ("shop/__init__.py", "shop/deep/__init__.py"), ("shop/cart.py", "shop/money.py"), ("shop/cart.py", "shop/deep/core.py"), ("shop/money.py", "shop/cart.py"), ("shop/money.py", "shop/deep/__init__.py"), ("shop/money.py", "shop/deep/core.py"), ("shop/deep/__init__.py", "shop/deep/core.py"), ("shop/broken.py", "shop/money.py"), ("shop/broken.py", "shop/cart.py"), ("tool.py", "shop/__init__.py"), ("tests/test_cart.py", "shop/cart.py")}
    assert edges() == plain
    assert edges(ingest.Options(type_checking=False)) == plain - {("shop/money.py", "shop/cart.py")}
    assert edges(ingest.Options(function_level=False)) == plain - {("shop/money.py", "shop/deep/core.py")}
    assert edges(ingest.Options(include_tests=False)) == plain - {("tests/test_cart.py", "shop/cart.py")}
    # Names that an __init__ passes on lead to where they are defined.
    assert edges(ingest.Options(defining=True)) - plain == {("tool.py", "shop/cart.py"), ("shop/__init__.py", "shop/deep/core.py")}
    assert edges(ingest.Options(parent_inits=True)) > plain
    assert ingest.import_edges(files.where("repo = 'other'")).count() == 0
    modules = ingest.discovered(files)
    why = {(r.path, r.target): r.reason for r in ingest.resolved(ingest.statements(files, modules), modules).where("repo = 'r' AND reason IS NOT NULL").collect()}
    assert why["shop/cart.py", "os"] == "stdlib" and why["shop/cart.py", "numpy"] == "third party" and why["shop/cart.py", "shop.deep.core.missing"] == "partly"
    assert why["shop/deep/core.py", None] == "beyond top" and why["shop/deep/core.py", "beyond.a"] == "not found"
    assert {r.construct: r.n for r in ingest.construct_counts(files, modules).where("repo = 'r'").collect()}["parse_failure"] == 1
    agree = ingest.edge_agreement(ingest.import_edges(files), ingest.import_edges(files, ingest.Options(type_checking=False))).where("repo = 'r'").first()
    assert (agree.both, agree.only_a, agree.only_b) == (11, 1, 0)


def test_discovery_of_inner_roots(spark):
    f = spark.createDataFrame([("r", p, "") for p in ("src/lib/__init__.py", "src/lib/a.py", "lib/a.py", "run.py", "__init__.py")], "repo string, path string, text string")
    m = {r.path: (r.module, r.reason) for r in ingest.discovered(f).collect()}
    assert m == {"src/lib/__init__.py": ("lib", None), "src/lib/a.py": (None, "duplicate"), "lib/a.py": ("lib.a", None), "run.py": ("run", None), "__init__.py": (None, "root")}


TEXT = """The cart breaks, see shop/cart.py and shop.money.price(x).

```
File "shop/cart.py", line 3
```
The money is gone; call `made` or price() twice. Carts and recart are words.
    indented cart
"""


def test_issue_mentions():
    issue = code.Issue(TEXT)
    assert issue.mention("cart") == "explicit" and issue.mention("gone") == "incidental" and issue.mention("absent") == "none" and issue.mention("made") == "explicit"
    assert [TEXT[a:b] for a, b in issue.files("cart")] == ["cart.py", "cart.py", "cart"]
    assert code.Issue(None).mention("x") == "none"
    flags = code.leakage(TEXT, ["shop/cart.py", "shop/gone.py"], "shop/money.py")
    assert flags == {"key_n": 2, "full": 1, "stem": 1, "explicit": 1, "incidental": 1, "seed_full": 0, "seed_stem": 1, "seed_explicit": 1}


def test_redaction(spark):
    text, n = code.redacted(TEXT, ["shop/cart.py"])
    assert n == 3 and "cart.py" not in text and "The cart breaks" in text and "shop/" in text
    text, n = code.redacted(TEXT, ["shop/cart.py"], "paths")
    assert "shop" not in text and "Carts" in text
    text, _ = code.redacted(TEXT, ["shop/cart.py"], "symbols", ["made", "price"])
    assert "made" not in text and "price" not in text and "The money is gone" in text
    assert code.redacted("nothing here", ["shop/cart.py"]) == ("nothing here", 0) and code.redacted(None, []) == ("", 0)
    d = spark.createDataFrame([(TEXT, ["shop/cart.py"], "names", None), (None, None, "symbols", ["x"])], "t string, k array<string>, m string, s array<string>")
    rows = d.select(code.redact_issue(F.col("t"), F.col("k"), F.col("m"), F.col("s")).alias("r"), code.leakage_flags(F.col("t"), F.col("k"), F.lit("a.py")).alias("f")).collect()
    assert [r.r.pieces for r in rows] == [3, 0] and rows[0].f.full == 1 and rows[1].f.key_n == 0


def test_cutting_against_marked_characters():
    """Pieces that overlap or touch become one; what is left is joined by blanks."""
    r = random.Random(7)
    for _ in range(500):
        text = "".join(r.choice("abcdef ") for _ in range(30))
        spans = [(a, a + r.randint(1, 6)) for a in (r.randint(0, 24) for _ in range(r.randint(0, 5)))]
        cut = [any(a <= i < b for a, b in spans) for i in range(30)]
        parts, was = [""], False
        for ch, c in zip(text, cut):
            if c and not was:
                parts.append("")
            elif not c:
                parts[-1] += ch
            was = c
        assert code.Issue(text).without(spans) == (" ".join(parts), len(parts) - 1)


def test_tasks_and_keys(spark, files):
    p = spark.createDataFrame([("i1", "r", PATCH), ("i2", "r", None)], "instance string, repo string, patch string")
    rows = {r.instance: r for r in ingest.task_rows(p).collect()}
    assert rows["i1"].edited == ["shop/b.py", "shop/cart.py"] and rows["i1"].new_files == ["shop/fresh.py"] and rows["i1"].deleted == ["shop/gone.py"] and rows["i1"].changed_lines == 8 and rows["i1"].file_group == "multi"
    assert rows["i2"].edited == [] and rows["i2"].file_group is None
    key = {(r.path, r.name) for r in ingest.symbol_key(p, files).collect()}
    assert key == {("shop/money.py", "price")}
    nodes = spark.createDataFrame([("r", "shop/cart.py"), ("r", "shop/money.py")], "repo string, path string")
    t = ingest.tasks(ingest.task_rows(p), ingest.symbol_key(p, files), nodes).collect()
    assert {(r.task, r.source, r.path, r.in_graph) for r in t} == {("i1::shop/cart.py", "co_edited", "shop/b.py", False), ("i1::shop/cart.py", "symbol", "shop/money.py", True)}
    g = spark.createDataFrame([("t", "r", "shop/cart.py", '["shop/money.py", "shop/cart.py", "a.md", "shop/none.py"]', ["shop/money.py"]), ("u", "r", "x.py", '["shop/money.py"]', ["x.py"])], "task string, repo string, seed string, files string, edited array<string>")
    assert {tuple(r) for r in ingest.gold_key(g, nodes).collect()} == {("t", "gold", "shop/money.py"), ("u", "gold", "shop/money.py"), ("u", "gold_readonly", "shop/money.py")}


def test_prefixes_and_chains(spark):
    rows = spark.createDataFrame([("a.b.c",), ("a.bc",), ("z",)], "name string")
    m = spark.createDataFrame([("a",), ("a.b",)], "module string")
    assert {(r.name, r.module) for r in joins.deepest_prefix(rows, "name", m, "module").collect()} == {("a.b.c", "a.b"), ("a.bc", "a"), ("z", None)}
    links = spark.createDataFrame([("a", "n", "b"), ("b", "n", "c"), ("c", "m", "d"), ("x", "n", "y"), ("y", "n", "x")], "pkg string, name string, target string")
    got = {(r.pkg, r.name): r.target for r in joins.chase(links).collect()}
    assert got["a", "n"] == got["b", "n"] == "c" and got["c", "m"] == "d" and {got["x", "n"], got["y", "n"]} <= {"x", "y"}
    kinds = spark.createDataFrame([("a/vendor/x.py", "", 1), ("a/x.py", "# Generated by y", 1), ("a/x.py", "", 3_000_000), ("a/x.py", "", 1), ("a/x.md", "", 1)], "p string, h string, n long")
    assert [r[0] for r in kinds.select(joins.file_class(F.col("p"), F.col("h"), F.col("n"))).collect()] == ["vendored", "generated", "other", "code", "other"]
