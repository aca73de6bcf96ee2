"""A query's rows beside those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (bool, int)):
        return int(v)
    if hasattr(v, "dtype") and v.dtype.kind in "biu":
        return int(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(sql).df()
