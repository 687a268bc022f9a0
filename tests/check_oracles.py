"""Compare registered queries with their SQL: ``python tests/check_oracles.py [sf dir] [names…]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    # Integers with nulls: pandas' own type from one engine, floats from the other.
    nullable = [c for c in frame.columns if isinstance(frame[c].dtype, pd.Int64Dtype | pd.Int32Dtype)]
    frame = frame.astype({c: "float64" for c in nullable})
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} and {len(sql_frame)} rows"
    a, b = normal(spark_frame), normal(sql_frame)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind or a[c].dtype.itemsize != b[c].dtype.itemsize:
            return f"{c}: types {a[c].dtype} and {b[c].dtype}"
        x, y = a[c].to_numpy(), b[c].to_numpy()
        same = (x == y) | (pd.isna(x) & pd.isna(y))
        if not np.all(same):
            i = int(np.flatnonzero(~same)[0])
            return f"{c}: {(~same).sum()} values, first {str(x[i])[:60]} and {str(y[i])[:60]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as contract
    from seqloom.session import local_session

    spark, con = local_session(), connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or list(queries):
        try:
            started = time.time()
            ours = queries[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name} {len(ours)} {took:.1f}s", flush=True)
                continue
            started = time.time()
            problem = difference(ours, con.execute(oracles[name]).df())
            sql_took = time.time() - started
        except Exception as e:  # report every query, whatever it raises
            problem, took, sql_took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {took:.1f}s sql {sql_took:.1f}s {problem or len(ours)}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
