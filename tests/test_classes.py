"""References between classes of files against the same references between the files."""

import random

import numpy as np
import pytest

from orrery.operators import orderings as O
from orrery.operators import walks

FILES = [f"f{i}.py" for i in range(14)]
OF = {p: f"c{i % 6}" for i, p in enumerate(FILES)}


def made(seed):
    r = random.Random(seed)
    pairs = {tuple(r.choice("012345") for _ in "ab") for _ in range(5)}
    classed = [(f"c{a}", f"c{b}", r.randint(1, 3), r.random() * 5) for a, b in sorted(pairs)]
    plain = [(a, b, n, w) for x, y, n, w in classed for a in FILES for b in FILES if OF[a] == x and OF[b] == y and a != b]
    return classed, plain


@pytest.mark.parametrize("seed", range(6))
def test_ranks(seed):
    classed, plain = made(seed)
    a, b = walks.Graph(FILES, [], plain), walks.Graph(FILES, [], classed, OF.items())
    for s in range(len(FILES)):
        np.testing.assert_allclose(b.reference_ranks(s), a.reference_ranks(s), atol=1e-14)


def test_searches(spark):
    classed, plain = made(7)
    df = spark.createDataFrame
    nodes, tasks = df([("r", p, 1) for p in FILES], "repo string, path string, cost long"), df([(f"t{i}", "r", p) for i, p in enumerate(FILES[:7])], "task string, repo string, seed string")
    edges = df([("r", FILES[0], FILES[3])], "repo string, src string, dst string")
    none = df([], "repo string, path string, term string, tf long"), df([], "task string, arm string, term string")
    rows = lambda refs: df([("r", *x) for x in refs], "repo string, src string, dst string, weight long, names double")
    calls = lambda refs: rows([x for x in refs if x[2] > 1]).select("repo", "src", "dst")
    own = lambda c, name: sorted(c.search(name).collect())
    a = O.Corpus(nodes, edges, tasks, none[0], none[0], none[1], refs=rows(plain), calls=calls(plain))
    b = O.Corpus(nodes, edges, tasks, none[0], none[0], none[1], refs=rows(classed), calls=calls(classed), classes=df([("r", p, c) for p, c in [*OF.items(), ("gone.py", "c0")]], "repo string, path string, class string"))
    for name in ("repograph_k1", "repograph_k2", "cosil_bfs", "locagent_bfs", "aider_repomap"):
        assert own(a, name) == own(b, name), name


def test_plans_make_no_pairs_of_files(spark, tmp_path):
    """Thirty copies of a part have the references of one."""
    from orrery.plans import ordering_plans as P

    for t in ("lineitem", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(50).write.parquet(f"{tmp_path}/{t}.parquet")
    part = [(7 * i, "red bolt", "b", "LARGE", 1) for i in range(30)] + [(14, "old bolt", "b", "SMALL", 1)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert P.corpus(spark, str(tmp_path)).refs.count() == 4
