"""Spark-vs-DuckDB comparison used by the tests (row count, column names and
order-insensitive values)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

from dealerlens.fixtures import RAW_TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        r = round(float(v), digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        v = v.replace(tzinfo=None)
        # DuckDB hands DATE columns to pandas as midnight timestamps.
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def normalize(pdf: pd.DataFrame, digits: int = 6) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c], digits) for c in cols) for r in pdf.to_dict("records")]
    rows.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return cols, rows


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, digits: int = 6) -> tuple[bool, str]:
    sc, sr = normalize(spark_pdf, digits)
    dc, dr = normalize(duck_pdf, digits)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first differing row:\n spark={a}\n duck ={b}"
    return True, f"{len(sr)} rows equal"
