"""Runs a query and its DuckDB twin over one folder of tables and compares them as multisets of rows.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if hasattr(x, "asDict"):
        return tuple(plain(i) for i in x)
    if isinstance(x, dict):
        return tuple(plain(i) for i in x.values())
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """An empty string if both agree, else what differs first."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET max_temp_directory_size='2GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = [tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) if sorted(columns) == names else r for r in rel.fetchall()]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    key = lambda r: tuple((x is None, str(type(x).__name__), str(x)) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        if a != b:
            return f"{names}: {a} and {b}"
    return "" if got else "no rows"


def main(sf_dir: str, *only: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad, queries, oracles = 0, e.queries(), e.oracle_sql()
    for name in only or queries:
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, name, queries[name], oracles[name], sf_dir)
            else:
                said = "" if queries[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s{'' if name in oracles else ', no SQL'})", flush=True)
        bad += bool(said)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main(*sys.argv[1:]))
