"""Run queries on Spark and their oracles on DuckDB and compare sorted rows."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return int(v) if v == int(v) else float(f"{v:.6g}")
        if isinstance(v, pd.Timestamp):
            return v.tz_localize(None).isoformat() if v.tz else v.isoformat()
        if hasattr(v, "item"):
            return cell(v.item())
        return v

    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def difference(spark, con, sf, query, sql):
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {odd}"
    return "" if a else "no rows"
