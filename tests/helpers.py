"""Comparison of a query's rows with those of SQL over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """Sorted columns and rows; whole numbers as exact integers, other numbers as floats, the rest as text."""
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "iub":
            if df[k].isna().any():  # nullable whole numbers stay exact
                df[k] = pd.Series([None if v is pd.NA else str(int(v)) for v in df[k]], df.index, object)
            else:
                df[k] = df[k].astype("int64")
        elif df[k].dtype.kind == "f" and len(df) and (df[k].dropna() % 1 == 0).all() and (df[k].dropna().abs() < 2**53).all():
            df[k] = df[k].astype("int64") if df[k].notna().all() else pd.Series([None if v != v else str(int(v)) for v in df[k]], df.index, object)
        elif df[k].dtype.kind == "f":
            df[k] = df[k].astype(float)
        else:
            df[k] = df[k].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    """Whole numbers and texts have to be equal, floats nearly."""
    got, want = _plain(got), _plain(want)
    assert list(got.columns) == list(want.columns)
    for k in got.columns:
        exact = "f" not in (got[k].dtype.kind, want[k].dtype.kind)
        pd.testing.assert_series_equal(got[k], want[k], check_dtype=False, check_exact=exact, **({} if exact else {"rtol": 1e-9}))
