"""Spark's rows against DuckDB's for a registered query."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def compared(frame: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.6f}" if abs(v) < 1e9 else f"{float(v):.9e}"
        return str(v)

    out = frame[sorted(frame.columns)].astype(object).map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark, query, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, wanted = compared(query(spark, sf).toPandas()), compared(con.sql(sql).df())
    assert list(got.columns) == list(wanted.columns)
    pd.testing.assert_frame_equal(got, wanted, check_dtype=False)
