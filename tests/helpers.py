"""Comparison of a query with its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v) -> str | None:
    """Text of one value; missing values of any kind are None, and whole numbers read alike as integer or double."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1 << 53 else repr(float(v))
    return str(v)


def cells(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple(v or "" for v in r))


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()
