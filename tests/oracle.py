"""Runs queries beside their SQL: python tests/oracle.py SF_DIR [NAME...] prints what differs."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def value(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(map(value, x))
    return x


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con: duckdb.DuckDBPyConnection, run, sql: str, sf_dir: str) -> str:
    """'' if both agree, else what differs."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from stratagraph.runtime import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = local_session(), connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in names):
            continue
        began = time.time()
        try:
            if name in sql:
                said = compare(spark, con, run, sql[name], sf_dir) or "same"
            else:
                said = f"no SQL, {run(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
