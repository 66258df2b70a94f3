"""Order-free comparison of a Spark result with DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return [tuple(sorted(frame.columns)), *sorted("|".join(map(text, r)) for r in frame.itertuples(index=False))]


def duck(sql, sf_dir, **frames):
    con = duckdb.connect()
    for t in TABLES:
        if t not in frames:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, table in frames.items():
        con.register(name, table)
    return con.sql(sql).df()
