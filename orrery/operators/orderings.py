"""Reading orders of a corpus of tasks: every ordering by name, from one set of scored tables.

A task names a repository and a seed file in it and may have an issue text. An ordering ranks
all other files of the repository: rows (task, path, pos), pos from 1. Equal scores are settled
by a hash of task and path. Orderings that need an issue have no rows for tasks without one;
fusions fall back to their structural list there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import levels, retrieval, walks
from orrery.staging import stage

#: Digits to which scores are rounded before they are ranked, so that equal ones are equal everywhere.
DIGITS = 9
#: What the arms of the redaction experiment are called in names of orderings.
ARMS = {"names": "_rd", "paths": "_rdp", "symbols": "_rds"}
#: Partitions in which lists of closures are put in order.
LISTS = 256


@dataclass
class Corpus:
    """The tables that orderings are made from; scored tables are made once, when first asked for.

    nodes(repo, path, cost), edges(repo, src, dst), tasks(task, repo, seed); bags and
    path_bags(repo, path, term, tf); queries(task, arm, term) with arm 'none' or a redacted one;
    vectors(repo, path, v) and query_vectors(task, arm, q); refs(repo, src, dst, weight, names)
    and calls(repo, src, dst). Paths are unique in a repository. With classes(repo, path, class) refs
    and calls are between classes and hold for all of their files, but for none with itself: each
    class is then searched once, however many files it has.
    """

    nodes: DataFrame
    edges: DataFrame
    tasks: DataFrame
    bags: DataFrame
    path_bags: DataFrame
    queries: DataFrame
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    refs: DataFrame | None = None
    calls: DataFrame | None = None
    classes: DataFrame | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def made(self, name: str, make: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
        """The table of a name; without `keep` it is not written, if it is not there already."""
        if name not in self._made:
            if not keep:
                return make()
            self._made[name] = stage(make(), "ordering")
        return self._made[name]

    @property
    def seeded(self) -> DataFrame:
        """Tasks whose seed is a file."""
        return self.tasks.join(self.nodes.select("repo", F.col("path").alias("seed")), ["repo", "seed"], "left_semi").select("task", "repo", "seed")

    @property
    def others(self) -> DataFrame:
        """(task, repo, seed, path, cost) of each task's files but the seed; tasks whose seed is no file have none."""
        return self.made("others", lambda: self.seeded.join(self.nodes, "repo").where("path <> seed").select("task", "repo", "seed", "path", "cost"))

    def bm25(self, corpus: str, query: str, arm: str = "none") -> DataFrame:
        """(task, path, score) of all other files: corpus 'text' or 'path', query 'issue' or 'seed'; tasks with an empty query have none."""

        def make() -> DataFrame:
            tf = self.bags if corpus == "text" else self.path_bags
            if query == "issue":
                terms = self.queries.where(F.col("arm") == arm).select("task", "term")
            else:
                own = tf.select("repo", F.col("path").alias("seed"), "term")
                terms = self.tasks.join(own, ["repo", "seed"]).select("task", "term")
            return retrieval.bm25_files(tf, self.nodes, self._made.get("seeded", self.seeded), terms.distinct())

        return self.made(f"bm25 {corpus} {query} {arm}", make)

    def dense(self, query: str, arm: str = "none") -> DataFrame:
        """(task, path, score): inner products with the issue's or the seed's vector; files without one score -2, tasks without one have no rows."""

        def make() -> DataFrame:
            if query == "issue":
                q = self.query_vectors.where(F.col("arm") == arm).select("task", "q")
            else:
                q = self.tasks.join(self.vectors.select("repo", F.col("path").alias("seed"), F.col("v").alias("q")), ["repo", "seed"]).select("task", "q")
            d = self.others.select("task", "repo", "path").join(q, "task").join(self.vectors, ["repo", "path"], "left")
            return d.select("task", "path", F.coalesce(T.dot(F.col("q"), F.col("v")), F.lit(-2.0)).alias("score"))

        return self.made(f"dense {query} {arm}", make)

    def walk(self, name: str) -> DataFrame:
        """(task, path, score) of one of walks.SCORES."""
        return self.made(f"walk {name}", lambda: walks.scores([name], self.nodes, self.edges, self.tasks).select("task", "path", "score"))

    def graph(self, name: str) -> DataFrame:
        """(repo, src, dst) of a graph without loops and unknown files: imports 'out', 'in' and 'und', 'refs' and 'calls' either way, 'mixed' imports and references either way; with classes only imports are listed, see steps()."""

        def make() -> DataFrame:
            if name in ("in", "und"):
                return levels.against(self.graph("out")) if name == "in" else levels.both_ways(self.graph("out"))
            if name == "mixed":
                return self.graph("und").union(self.graph("refs")).distinct()
            rows = {"out": self.edges, "refs": self.refs, "calls": self.calls}[name]
            known = self.nodes.select("repo", "path").distinct()
            own = rows.where("src <> dst").select("repo", "src", "dst").join(known.withColumnRenamed("path", "src"), ["repo", "src"], "left_semi").join(known.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi")
            own = own.select("repo", "src", "dst").distinct()
            return own if name == "out" else levels.both_ways(own)

        return self.made(f"graph {name}", make)

    def steps(self, name: str) -> list[levels.Step]:
        """What a hop in graph(name) is made of."""
        if self.classes is None or name not in ("refs", "calls", "mixed"):
            return [levels.along(self.graph(name))]
        pairs = levels.both_ways(self.calls if name == "calls" else self.refs)
        known = self.classes.join(self.nodes.select("repo", "path"), ["repo", "path"], "left_semi")
        own = [levels.through(known.withColumnRenamed("path", "node"), pairs)]
        return own if name != "mixed" else [levels.along(self.graph("und")), *own]

    def reached(self, name: str) -> DataFrame:
        """(task, repo, path, dist) of what each task's seed reaches in a graph, the seed itself at 0; in 'refs', of which no order goes further, in two hops."""

        def make() -> DataFrame:
            if name in ("out", "in", "und"):
                d = self.searched(name).join(self.seeds().select("repo", "block", "bit", "task"), ["repo", "block", "bit"])
                return self.named(d, "node", "path").select("task", "repo", "path", "dist")
            seeds = self.tasks.join(self.nodes.select("repo", F.col("path").alias("seed")), ["repo", "seed"], "left_semi").select("repo", F.col("task").alias("source"), F.col("seed").alias("node"))
            most = 2 if name == "refs" else None
            return levels.reached(self.steps(name), seeds, most).select(F.col("source").alias("task"), "repo", F.col("node").alias("path"), "dist")

        return self.made(f"reached {name}", make)

    def by_node(self, name: str) -> DataFrame:
        """(repo, path, score) of 'closeness' or 'betweenness', which have no seed."""
        count = levels.closeness if name == "closeness" else levels.betweenness
        d = self.made(name, lambda: count(self.numbers().select("repo", "node"), self._imports(), places=True))
        return self.named(d, "node", "path").select("repo", "path", "score")

    def numbers(self) -> DataFrame:
        """(repo, path, node): the places of a repository's files by path, from 0."""

        def make() -> DataFrame:
            d = levels.numbered(self.nodes.select("repo", F.col("path").alias("source"), F.col("path").alias("node")))
            return d.select("repo", F.col("node").alias("path"), (F.col("block") * levels.WIDTH + F.col("bit")).alias("node"))

        return self.made("numbers", make)

    def named(self, rows: DataFrame, node: str, path: str) -> DataFrame:
        """rows with the `path` of a number of numbers()."""
        return rows.join(self.numbers().select("repo", F.col("node").alias(node), F.col("path").alias(path)).hint("merge"), ["repo", node])

    def _imports(self) -> DataFrame:
        """graph('out') of numbers."""

        def make() -> DataFrame:
            d = self.edges.where("src <> dst").select("repo", F.col("src").alias("a"), F.col("dst").alias("b"))
            for path, node in (("a", "src"), ("b", "dst")):
                d = d.join(self.numbers().select("repo", F.col("path").alias(path), F.col("node").alias(node)).hint("merge"), ["repo", path])
            return d.select("repo", "src", "dst").distinct()

        return self.made("imports", make)

    def _around(self) -> DataFrame:
        return self.made("around", lambda: levels.around(self._imports()))

    def _marked(self) -> DataFrame:
        return self.made("marked", lambda: levels.marked(self._imports(), self._around()))

    def parts(self) -> DataFrame:
        """(repo, node, root) of numbers: strongly connected components of the imports."""
        return self.made("parts", lambda: levels.strong_components(self.numbers(), self._imports(), self._marked()))

    def components(self) -> DataFrame:
        """(repo, node, root): strongly connected components of the imports."""
        d = self.named(self.named(self.parts(), "node", "path"), "root", "least")
        return d.select("repo", F.col("path").alias("node"), F.col("least").alias("root"))

    def seeds(self) -> DataFrame:
        """(repo, block, bit, task, node, seed) of seeded tasks: their places in a repository."""

        def make() -> DataFrame:
            at = self.seeded.join(self.numbers().withColumnRenamed("path", "seed").hint("merge"), ["repo", "seed"])
            at = at.select("repo", F.col("task").alias("source"), F.struct("node", "seed").alias("node"))
            return levels.numbered(at).select("repo", "block", "bit", F.col("source").alias("task"), "node.node", "node.seed")

        return self.made("seeds", make)

    def searched(self, name: str) -> DataFrame:
        """(repo, block, bit, node, dist) of numbers: what seeds() reach along the imports ('out'), against them ('in') or either way ('und')."""

        def make() -> DataFrame:
            e = self._imports()
            e = e if name == "out" else levels.against(e) if name == "in" else levels.both_ways(e)
            return levels.searched(e, self.seeds().select("repo", "block", "bit", "node"))

        return self.made(f"searched {name}", make)

    def closed(self, *ways: str) -> tuple[DataFrame, DataFrame]:
        """(repo, node, sets) of levels.closures() for the seeds, and the tasks (repo, block, bit, task, seed) that the bits stand for; from searched() where all ways have been searched already."""
        if all(f"searched {way}" in self._made for way in ways):
            found = reduce(DataFrame.unionByName, [self.searched(way) for way in ways])
            seen = found.groupBy("repo", "node", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("seen"))
            sets = seen.groupBy("repo", "node").agg(F.collect_list(F.struct("block", "seen")).alias("sets"))
        else:
            sets = levels.closures(self._marked(), self._around(), self.seeds().select("repo", "node", "block", "bit"), *ways)
        return sets, self.seeds().select("repo", "block", "bit", "task", "seed")

    def search(self, name: str, keep: bool = True) -> DataFrame:
        """(task, path, pos) of one of BY_JOINS or walks.ORDERS; without `keep` the list, which has a row for each task and file, is not written."""
        if name in BY_JOINS:
            return self.made(f"order {name}", lambda: BY_JOINS[name](self).select("task", "path", F.col("pos").cast("int").alias("pos")), keep)
        d = self.made(f"order {name}", lambda: walks.orders([name], self.nodes, self.edges, self.tasks, self.refs, self.classes), keep)
        return d.select("task", "path", "pos")

    def hops(self) -> DataFrame:
        """(task, path, cost, dist): hops from the seed, one more than there are files where there is no way."""

        def make() -> DataFrame:
            size = self.nodes.groupBy("repo").agg((F.count("*") + 1).cast("int").alias("far"))
            near = self.reached("und").select("task", "path", "dist")
            return self.others.join(size, "repo").join(near, ["task", "path"], "left").select("task", "path", "cost", F.coalesce("dist", "far").alias("dist"))

        return self.made("hops", make)

    def ordering(self, name: str) -> DataFrame:
        """(task, path, pos) of an ordering of ORDERINGS."""
        return self.made(f"ordering {name}", lambda: ORDERINGS[name](self).select("task", "path", F.col("pos").cast("int").alias("pos")))


def by_score(scores: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(task, path, pos): descending score, ties by hash. A task's order is a window of its own."""
    return ordered(scores.withColumn("_s", F.round("score", digits)), F.desc("_s"))


def ordered(rows: DataFrame, *by: Column) -> DataFrame:
    w = Window.partitionBy("task").orderBy(*by, T.tie_key(F.col("task"), F.col("path")))
    return rows.select("task", "path", F.row_number().over(w).alias("pos"))


def fused(c: Corpus, *names: str, k: int = retrieval.RRF_K) -> DataFrame:
    lists = [c.ordering(n).select("task", F.col("path").alias("doc"), "pos") for n in names]
    return by_score(retrieval.rrf(*lists, k=k).select("task", F.col("doc").alias("path"), "score"))


def _or_else(c: Corpus, made: DataFrame, needed: str, instead: str) -> DataFrame:
    """`made` for tasks that `needed` has rows for, the list `instead` for the others."""
    has = c.ordering(needed).select("task").distinct()
    return made.join(has, "task", "left_semi").unionByName(c.ordering(instead).select("task", "path", "pos").join(has, "task", "left_anti"))


def _per_line(c: Corpus, scores: DataFrame) -> DataFrame:
    return scores.join(c.others.select("task", "path", "cost"), ["task", "path"]).select("task", "path", (F.col("score") / F.col("cost")).alias("score"))


def _fusion(structure: str, *rest: str, arm: str = "", k: int = retrieval.RRF_K) -> Callable[[Corpus], DataFrame]:
    lists = [f"{r}{arm}" for r in rest]
    return lambda c: _or_else(c, fused(c, structure, *lists, k=k), f"bm25_issue{arm}", structure)


def _same_dir(c: Corpus) -> DataFrame:
    # A file of the root is compared by its whole name with the seed's empty folder, so two such files differ.
    folder = lambda p: F.when(F.instr(p, "/") > 0, T.parent_dir(F.col(p)))
    same = F.coalesce(folder("path"), F.col("path")) == F.coalesce(folder("seed"), F.lit(""))
    return by_score(c.others.withColumn("score", same.cast("double")))


def _completed(name: str) -> Callable[[Corpus], DataFrame]:
    """A selector's list, then all other files by hash."""

    def make(c: Corpus) -> DataFrame:
        head = c.others.select("task", "path").join(c.search(name).withColumnRenamed("pos", "head"), ["task", "path"], "left")
        return ordered(head, F.asc_nulls_last("head"))

    return make


def _dense_fusion(*names: str) -> Callable[[Corpus], DataFrame]:
    return lambda c: fused(c, *names).join(c.ordering("dense_issue").select("task").distinct(), "task", "left_semi")


def _near(c: Corpus, name: str, most: int | None = None) -> DataFrame:
    return c.reached(name).where("dist > 0" if most is None else f"dist BETWEEN 1 AND {most}")


def _closure(c: Corpus, *ways: str) -> DataFrame:
    """What the seeds reach along the imports, against them or in one of both ways, by hash."""
    found, tasks = c.closed(*ways)
    return _listed(c.named(found, "node", "path"), tasks)


def _eights(tasks: DataFrame) -> DataFrame:
    """(repo, group, own): eight tasks of a repository side by side."""
    return tasks.groupBy("repo", (F.col("block") * (levels.WIDTH // 8) + F.floor(F.col("bit") / 8)).alias("group")).agg(F.collect_list(F.struct((F.col("bit") % 8).alias("bit"), "task", "seed")).alias("own"))


def _listed(rows: DataFrame, tasks: DataFrame, *by: Column) -> DataFrame:
    """(task, path, pos) of rows(repo, path, sets, ...) and tasks as closed() gives them; `by` may use all columns of rows and tasks, ties go by hash.

    Rows are dealt out by repository and eight tasks, so a file comes once for these, and hashes are taken where lists are sorted.
    """
    rest = [k for k in rows.columns if k not in ("repo", "node", "sets")]
    each = rows.select("repo", *rest, F.explode("sets").alias("x")).select("repo", *rest, F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels.WIDTH // 8 - 1)), lambda i: F.struct((F.col("x.block") * (levels.WIDTH // 8) + i).alias("group"), F.call_function("shiftrightunsigned", F.col("x.seen"), i * 8).bitwiseAND(F.lit(255)).cast("short").alias("bits")))).alias("y"))
    each = each.select("repo", *rest, "y.*").where("bits <> 0").repartition(LISTS, "repo", "group")
    d = each.join(stage(_eights(tasks), "tasks"), ["repo", "group"])
    d = d.select("repo", "group", *rest, F.explode(F.filter("own", lambda t: F.call_function("getbit", F.col("bits"), t.bit) == 1)).alias("t")).select("repo", "group", *rest, "t.task", "t.seed").where("path <> seed")
    w = Window.partitionBy("repo", "group", "task").orderBy(*by, F.unhex(T.tie_key(F.col("task"), F.col("path"))))
    return d.select("task", "path", F.row_number().over(w).alias("pos"))


def _topological(c: Corpus) -> DataFrame:
    """Each file after all that it depends on; members of a component lie together, components of one height go by their roots' hashes."""
    peeled = c.made("heights", lambda: levels.peeled(c.numbers().select("repo", "node"), c._imports()))
    found, tasks = c.closed("out")
    rows = c.named(c.named(found.join(peeled.hint("merge"), ["repo", "node"]), "node", "path"), "root", "least").select("repo", "path", "sets", "height", "least")
    return _listed(rows, tasks, F.col("height"), F.unhex(T.tie_key(F.col("task"), F.col("least"))), F.col("least"))


def _typed(c: Corpus) -> DataFrame:
    """Levels over imports and references together; within a level, files that an import reached come first."""
    d = c.reached("mixed")
    by_import = d.join(c.graph("und").withColumnRenamed("src", "path"), ["repo", "path"]).select("task", F.col("dst").alias("path"), (F.col("dist") + 1).alias("dist")).distinct()
    return ordered(d.where("dist > 0").join(by_import.withColumn("kind", F.lit(0)), ["task", "path", "dist"], "left"), F.col("dist"), F.coalesce("kind", F.lit(1)))


def _central(name: str) -> Callable[[Corpus], DataFrame]:
    """By a score that files have whatever the task; as in _listed() a file comes once for eight tasks, and files of all tasks are not written."""

    def make(c: Corpus) -> DataFrame:
        rows = c.by_node(name).select("repo", "path", F.round("score", DIGITS).alias("score"))
        d = rows.join(stage(_eights(c.seeds()), "tasks"), "repo").repartition(LISTS, "repo", "group")
        d = d.select("repo", "group", "path", "score", F.explode("own").alias("t")).select("repo", "group", "path", "score", "t.task", "t.seed").where("path <> seed")
        w = Window.partitionBy("repo", "group", "task").orderBy(F.desc("score"), F.unhex(T.tie_key(F.col("task"), F.col("path"))))
        return d.select("task", "path", F.row_number().over(w).alias("pos"))

    return make


#: Selections and orders that are made of levels, components and counts by joins: what they do not reach is not listed.
BY_JOINS: dict[str, Callable[[Corpus], DataFrame]] = {
    "bfs_fwd": lambda c: ordered(_near(c, "out"), F.col("dist")),
    "bfs_rev": lambda c: ordered(_near(c, "in"), F.col("dist")),
    "bfs_und": lambda c: ordered(_near(c, "und"), F.col("dist")),
    "closure_fwd": lambda c: _closure(c, "out"),
    "closure_rev": lambda c: _closure(c, "in"),
    "closure_comb": lambda c: _closure(c, "out", "in"),
    "khop1_und": lambda c: ordered(_near(c, "und", 1)),
    "khop2_und": lambda c: ordered(_near(c, "und", 2)),
    "closure_fwd_trim": lambda c: ordered(_near(c, "out"), F.col("dist")),
    "topo_fwd": _topological,
    "indegree": lambda c: c.ordering("indegree"),
    "closeness": _central("closeness"),
    "betweenness": _central("betweenness"),
    "repograph_k1": lambda c: ordered(_near(c, "refs", 1)),
    "repograph_k2": lambda c: ordered(_near(c, "refs", 2), F.col("dist")),
    "locagent_bfs": _typed,
    "cosil_bfs": lambda c: ordered(_near(c, "calls"), F.col("dist")),
}

#: Every ordering by name.
ORDERINGS: dict[str, Callable[[Corpus], DataFrame]] = {
    "bfs_und": lambda c: ordered(c.hops(), F.col("dist")),
    "hops_lines": lambda c: c.hops().select("task", "path", F.row_number().over(Window.partitionBy("task").orderBy("dist", "cost", "path")).alias("pos")),
    "ppr_und": lambda c: by_score(c.walk("ppr_und")),
    "ppr_und_pl": lambda c: by_score(_per_line(c, c.walk("ppr_und"))),
    "ppr_out": lambda c: by_score(c.walk("ppr_out")),
    "ppr_out_pl": lambda c: by_score(_per_line(c, c.walk("ppr_out"))),
    "ppr_in": lambda c: by_score(c.walk("ppr_in")),
    "ppr_in_pl": lambda c: by_score(_per_line(c, c.walk("ppr_in"))),
    "pagerank": lambda c: by_score(c.walk("pagerank")),
    "indegree": lambda c: by_score(c.others.join(c.edges.distinct().groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("n")), ["repo", "path"], "left").withColumn("score", F.coalesce("n", F.lit(0)).cast("double"))),
    "bm25_seed": lambda c: by_score(c.bm25("text", "seed")),
    "bm25_issue": lambda c: by_score(c.bm25("text", "issue")),
    "bm25_issue_pl": lambda c: by_score(_per_line(c, c.bm25("text", "issue"))),
    "path_issue": lambda c: by_score(c.bm25("path", "issue")),
    "path_seed": lambda c: by_score(c.bm25("path", "seed")),
    "rrf_ppr_issue": _fusion("ppr_und", "bm25_issue"),
    "rrf_ppr_issue_path": _fusion("ppr_und", "bm25_issue", "path_issue"),
    "rrf_hops_path": _fusion("hops_lines", "path_issue"),
    "rrf_hops_issue_path": _fusion("hops_lines", "bm25_issue", "path_issue"),
    "rrf_pprpl_issue_path": _fusion("ppr_und_pl", "bm25_issue", "path_issue"),
    "same_dir": _same_dir,
    "random": lambda c: ordered(c.others, T.tie_key(F.lit("random"), F.col("task"), F.col("path"))),
    "rrf_hops_pathseed": lambda c: fused(c, "hops_lines", "path_seed"),
    "rrf_pprpl_seedpath": lambda c: fused(c, "ppr_und_pl", "bm25_seed", "path_seed"),
    "rrf_pprpl_issue_path_k10": _fusion("ppr_und_pl", "bm25_issue", "path_issue", k=10),
    "rrf_pprpl_issue_path_k200": _fusion("ppr_und_pl", "bm25_issue", "path_issue", k=200),
    "dense_issue": lambda c: by_score(c.dense("issue")),
    "dense_seed": lambda c: by_score(c.dense("seed")),
    "rrf_pprpl_dense": _dense_fusion("ppr_und_pl", "dense_issue"),
    "rrf_pprpl_dense_path": _dense_fusion("ppr_und_pl", "dense_issue", "path_issue"),
    "rrf_pprpl_issue_path_dense": _dense_fusion("ppr_und_pl", "bm25_issue", "path_issue", "dense_issue"),
    "rrf_pprpl_seeddense_path": lambda c: _or_else(c, fused(c, "ppr_und_pl", "dense_seed", "path_seed"), "dense_seed", "ppr_und_pl"),
    "sys_aider_repomap": _completed("aider_repomap"),
    "sys_repograph_k2": _completed("repograph_k2"),
    "sys_locagent_bfs": _completed("locagent_bfs"),
}


def _arm(arm: str, end: str) -> dict[str, Callable[[Corpus], DataFrame]]:
    """The issue-queried orderings with the issue of a redaction arm."""

    def dense(c: Corpus) -> DataFrame:
        return by_score(c.dense("issue", arm)).join(c.ordering("dense_issue").select("task").distinct(), "task", "left_semi")

    def both(c: Corpus) -> DataFrame:
        return fused(c, "ppr_und_pl", f"dense_issue{end}", f"path_issue{end}").join(c.ordering(f"dense_issue{end}").select("task").distinct(), "task", "left_semi")

    return {
        f"bm25_issue{end}": lambda c: by_score(c.bm25("text", "issue", arm)),
        f"path_issue{end}": lambda c: by_score(c.bm25("path", "issue", arm)),
        f"rrf_hops_path{end}": _fusion("hops_lines", "path_issue", arm=end),
        f"rrf_pprpl_issue_path{end}": _fusion("ppr_und_pl", "bm25_issue", "path_issue", arm=end),
        f"dense_issue{end}": dense,
        f"rrf_pprpl_dense_path{end}": both,
    }


for _name, _end in ARMS.items():
    ORDERINGS |= _arm(_name, _end)


def oracle(c: Corpus, keys: DataFrame) -> DataFrame:
    """(task, source, path, pos): the key's files, cheapest first; keys(task, source, path) outside the graph, and the seed, are left out."""
    k = c.others.select("task", "path", "cost").join(keys.distinct(), ["task", "path"])
    w = Window.partitionBy("task", "source").orderBy("cost", T.tie_key(F.col("task"), F.col("path")))
    return k.select("task", "source", "path", F.row_number().over(w).alias("pos"))


def localised(c: Corpus) -> DataFrame:
    """(task, seed): the file that a fusion of the issue's BM25 and path lists puts first, among all files of the repository."""
    none = Corpus(c.nodes, c.edges, c.tasks.withColumn("seed", F.lit("")), c.bags, c.path_bags, c.queries)
    whole = none.tasks.join(none.nodes, "repo").select("task", "repo", "seed", "path", "cost")
    none._made |= {"others": whole, "seeded": none.tasks}
    s = retrieval.rrf(*(by_score(none.bm25(k, "issue")).withColumnRenamed("path", "doc") for k in ("text", "path")))
    tie = T.tie_key(F.col("task"), F.col("doc"))
    return s.groupBy("task").agg(F.max_by("doc", F.struct(F.round("score", DIGITS), F.translate(tie, "0123456789abcdef", "fedcba9876543210"))).alias("seed"))


def union_all(c: Corpus, names: list[str]) -> DataFrame:
    """(task, method, path, pos) of several orderings."""
    return reduce(DataFrame.unionByName, [c.ordering(n).withColumn("method", F.lit(n)) for n in names])
