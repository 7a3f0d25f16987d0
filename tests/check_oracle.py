"""Run every named query beside its SQL on a scale factor: python tests/check_oracle.py SF_DIR [names]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

import __spark_entry__ as driver
from aislefix.session import build_session

TABLES = ("lineitem", "orders", "supplier", "pages", "conversations", "documents", "embeddings")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(df, con, name: str) -> str | None:
    """What differs between the query's result and its SQL's, or None."""
    got = df.toPandas()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    got, want = normal(got), normal(want)
    for column in got.columns:
        if got[column].dtype.kind != want[column].dtype.kind:
            return f"{column}: {got[column].dtype}, not {want[column].dtype}"
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{column}: {(~same).sum()} rows, e.g. {got[column][at]!r}, not {want[column][at]!r}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1]
    names = sys.argv[2:] or list(driver.queries())
    spark = build_session(cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = difference(driver.queries()[name](spark, folder), con, name)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{name:24} {time.time() - start:6.2f}s  {found or 'same'}", flush=True)
    print("failed:", failed)
