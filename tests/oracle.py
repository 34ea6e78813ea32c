"""Compares a Spark result with DuckDB's, without regard to row order."""
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return v.item() if hasattr(v, "item") and not isinstance(v, bool) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, ([_plain(v) for v in r] for r in frame.astype(object).itertuples(index=False, name=None))))


def same(spark_frame, duck_frame):
    a, b = spark_frame.toPandas(), duck_frame.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
