"""Merged spans against their SQL, on lengths with fractions, halves and gaps, and on repeated spans."""

import duckdb

from orrery.plans import study_plans


def test_interval_merge(spark, tmp_path):
    rows = [(1, 10, 4.6), (1, 15, 3.0), (1, 30, 2.5), (1, 33, 1.0), (1, 40, 3.5), (1, 44, 1.0), (1, 60, None), (1, 60, 4.0), (1, 80, None), (1, 80, None), (2, 7, 1.4), (2, 7, 1.4), (2, 9, 0.4), (None, 5, 2.0), (None, 1007, 2.0), (3, None, 2.0), (3, 5, 9.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    wanted = db.sql(study_plans.ORACLE_SQL["interval_merge"]).fetchall()
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, study_plans.interval_merge(spark, str(tmp_path)).collect()), key=by) == sorted(wanted, key=by)
