"""Compare registered queries with their oracle texts."""

from __future__ import annotations

import sys
import time
import warnings

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("object").map(lambda v: None if v is None else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64") + 0.0
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    out = {}
    for c in df.columns:
        t = df[c].dtype
        out[c] = ("bool" if pd.api.types.is_bool_dtype(t) else "int" if pd.api.types.is_integer_dtype(t)
                  else "float" if pd.api.types.is_float_dtype(t) else "other")
    return out


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    gk, wk = kinds(got), kinds(want)
    odd = {c: (gk[c], wk[c]) for c in gk if gk[c] != wk[c] and not got[c].isna().any() and not want[c].isna().any()}
    if odd:
        return f"types {odd}"
    a, b = _canonical(got), _canonical(want)
    for c in a.columns:
        if a[c].dtype == "float64" and b[c].dtype == "float64":
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        else:
            bad = ~((a[c].astype("object") == b[c].astype("object")) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} differ, first {a[c][i]!r} != {b[c][i]!r}"
    return None


def check(spark, con, name: str, sf: str, queries: dict, oracles: dict) -> str:
    start = time.time()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = queries[name](spark, sf).toPandas()
    took = time.time() - start
    if name not in oracles:
        return f"rows-only {len(got)} rows {took:.1f}s"
    start = time.time()
    want = con.execute(oracles[name]).fetchdf()
    problem = differences(got, want)
    return (f"OK {len(got)} rows" if problem is None else f"FAIL {problem}") + f" {took:.1f}s/{time.time()-start:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from verispark.session import build_session

    folder = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    wanted = [a for a in sys.argv[1:] if not a.startswith("/")]
    session = build_session(master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection = connect(folder)
    for key in queries:
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            print(f"{key:38s} {check(session, connection, key, folder, queries, oracles)}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{key:38s} ERROR {type(error).__name__} {str(error)[:600]}", flush=True)
