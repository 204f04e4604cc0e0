from __future__ import annotations

import duckdb

from lumenspark import plans


def test_clock_text_of_large_keys(spark, tmp_path):
    """From 100 hours on the SQL's lpad leaves the first two digits of the hours; nothing starts again at 360,000 seconds."""
    keys = [0, 97, 9729, 9730, 90_000, 899_999]
    spark.createDataFrame(list(enumerate(keys)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = sorted(con.execute(plans.ORACLES["clock_text"]).fetchall())
    assert sorted(map(tuple, plans.QUERIES["clock_text"](spark, str(tmp_path)).collect())) == want
