"""Compare registered queries with their SQL on the same Parquet files."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6).map(lambda x: "NULL" if pd.isna(x) else f"{x:.4f}")
        else:
            df[c] = df[c].map(lambda x: "NULL" if x is None or x is pd.NA or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short account of what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    kinds = [
        c
        for c in got.columns
        if pd.api.types.is_numeric_dtype(got[c]) != pd.api.types.is_numeric_dtype(want[c])
        and got[c].notna().any()
    ]
    if kinds:
        return f"types {[(c, str(got[c].dtype), str(want[c].dtype)) for c in kinds]}"
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        cols = [c for c in a.columns if a.loc[i, c] != b.loc[i, c]]
        return f"{int(bad.sum())} of {len(a)} rows; first {a.loc[i].to_dict()} vs {b.loc[i, cols].to_dict()}"
    return None
