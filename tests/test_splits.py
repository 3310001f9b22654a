"""Held-out splits in full against the SQL."""

import duckdb

from orrery.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_splits(spark):
    got = sorted((r.split, r.chosen, r["rank"], round(r.auc, 5)) for r in QUERIES["heldout_splits"](spark, SF).collect())
    assert [r[0] for r in got] == list(range(200))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == sorted((a, b, c, round(d, 5)) for a, b, c, d in con.execute(ORACLE_SQL["heldout_splits"]).fetchall())
