"""Run registered queries next to their oracle SQL and compare rows, names and values.

    python tests/compare.py <sf> [name ...]
"""

import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np
import pandas as pd

TESTDATA = "/root/testdata"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cells(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "NULL"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, np.integer)):
            return repr(float(x)) if abs(int(x)) < 2**53 else str(int(x))
        if isinstance(x, (float, np.floating)):
            return repr(float(x))
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(x) for x in row) for row in df.itertuples(index=False, name=None))


def differences(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    a, b = _cells(spark_df), _cells(oracle_df)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        return f"{len(sa - sb)} of {len(a)} rows differ\n   spark  {only_a}\n   oracle {only_b}"
    kinds = lambda d: {c: "f" if d[c].isna().any() else d[c].dtype.kind for c in d.columns}  # integers with nulls come in several types
    ka, kb = kinds(spark_df), kinds(oracle_df)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    return f"types {odd}" if odd and len(a) else None


def _late(signum, frame):
    raise TimeoutError("took more than 150 s")


def main(sf: str, names: list[str]) -> int:
    from duoframe import local_session
    from duoframe.queries import ORACLE, QUERIES

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{TESTDATA}/sf{sf}")
    signal.signal(signal.SIGALRM, _late)
    bad = 0
    for name in names or list(QUERIES):
        t0 = time.time()
        signal.alarm(150)
        try:
            got = QUERIES[name](spark, f"{TESTDATA}/sf{sf}").toPandas()
        except Exception as e:  # report and go on with the next query
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}")
            bad += 1
            continue
        took = time.time() - t0
        signal.alarm(0)
        if name not in ORACLE:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s")
            if names:
                print(got.head(8).to_string())
            continue
        try:
            t1 = time.time()
            want = con.sql(ORACLE[name]).df()
            t1 = time.time() - t1
        except Exception as e:
            print(f"FAIL {name} oracle: {str(e)[:600]}")
            bad += 1
            continue
        diff = differences(got, want)
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}: {len(got)} rows, {took:.1f}s, oracle {t1:.1f}s {diff or ''}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
