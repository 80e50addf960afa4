"""Holds a query's rows against its SQL, run by DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").fillna(-9e99)
        else:
            df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark, sf, con, query, sql):
    got, want = plain(query(spark, sf).toPandas()), plain(con.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=1.1e-6)
