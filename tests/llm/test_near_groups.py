"""Large groups of near copies: what travels between the steps, and the bytes that a Python worker gets at once."""

import random

import pyarrow as pa

from orrery.llm import near_dedup
from orrery.staging import stage

from test_ops import brute_groups, docs_of


def test_members_of_several_buckets_are_one_row(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = [(i, " ".join(f"z{r.randrange(10**9)}" if r.random() < 0.04 else w for w in base)) for i in range(60)]
    seen, several, staged = {}, near_dedup._in_several, near_dedup.stage

    def spied(rows, group, *key):
        if key == ("k",):
            seen["held"] = rows.count()
        return several(rows, group, *key)

    def counted(df, name, *rest, **more):
        out = staged(df, name, *rest, **more)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "_in_several", spied)
    monkeypatch.setattr(near_dedup, "stage", counted)
    rows = near_dedup.near_duplicates(docs_of(spark, texts), width=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == brute_groups(texts, 2, 80)
    assert seen["held"] == seen["stars"] < seen["members"] / 4


def test_batches_are_bounded(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 1000) AS t").mapInArrow(run, "n long")
    assert max(x.n for x in stage(wide, "wide", batch="1m").collect()) < 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "1m"
