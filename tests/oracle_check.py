"""Compare ``queries()[name]`` with ``oracle_sql()[name]`` the way the driver does:
row count, column names, and an order-insensitive multiset of normalised rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if os.environ.get("ORACLE_STRICT"):  # raw doubles, as a value hash would see them
            return v + 0.0
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(_norm(x) for x in rec)] += 1
    return cols, out


def compare(spark, con, sf_dir: str, name: str, queries, oracle) -> tuple[bool, str]:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if name not in oracle:
        return True, f"rows-only {len(spdf)} rows spark={t1 - t0:.1f}s"
    opdf = con.execute(oracle[name]).df()
    scols, srows = rows_of(spdf)
    ocols, orows = rows_of(opdf)
    if scols != ocols:
        return False, f"columns differ spark={scols} oracle={ocols}"
    if len(spdf) != len(opdf):
        return False, f"row count spark={len(spdf)} oracle={len(opdf)}"
    if srows != orows:
        diff_s = list((srows - orows).items())[:3]
        diff_o = list((orows - srows).items())[:3]
        return False, f"values differ: spark-only {diff_s} oracle-only {diff_o}"
    return True, f"{len(spdf)} rows spark={t1 - t0:.1f}s"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from corpusmill.session import build_session
    spark = build_session("local[8]", 8)
    queries, oracle = E.queries(), E.oracle_sql()
    names = argv[2:] or list(queries)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, sf_dir, n, queries, oracle)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
