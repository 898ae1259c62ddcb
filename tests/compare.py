"""Compare registered queries with their oracle SQL: ``python tests/compare.py [sf] [names...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        elif kind in "iufb":
            df[c] = df[c].astype("float64" if kind in "uf" else df[c].dtype)
        else:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    kinds = {c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in spark_df.columns}
    a, b = canonical(spark_df), canonical(sql_df)
    bad = {}
    for c in a.columns:
        if {a[c].dtype.kind, b[c].dtype.kind} <= set("iufb"):
            x, y = a[c].astype(float), b[c].astype(float)
        else:
            x, y = a[c].astype(str), b[c].astype(str)
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            bad[c] = (int((~same).sum()), x[i], y[i])
    if bad:
        return f"values {bad}"
    types = {c: k for c, k in kinds.items() if k[0] != k[1] and not set(k) <= set("OMfi")}
    return f"types {types}" if types else None


def main() -> None:
    import __spark_entry__ as entry
    from fluxgauge.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{DATA}/sf{sf}"
    spark = build_session(
        "compare", "local[8]",
        settings={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in oracle:
                problem = difference(got, con.execute(oracle[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            took, problem, got = time.time() - started, f"{type(error).__name__}: {str(error)[:700]}", ()
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:36s} {took:6.2f}s rows={len(got)} {'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
