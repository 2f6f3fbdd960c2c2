"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: row count, column names, order-insensitive values
(doubles rounded to 6 places).
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from invoxa.session import get_spark  # noqa: E402
from invoxa.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(df_pd):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir).toPandas()
        t1 = time.time()
        if name not in sql:
            print(f"{name:28s} rows={len(sdf):7d} spark={t1 - t0:5.1f}s  (no oracle)")
            continue
        ddf = con.execute(sql[name]).df()
        sc, sr = rows_of(sdf)
        dc, dr = rows_of(ddf)
        ok = sc == dc and sr == dr
        bad += not ok
        print(f"{name:28s} rows={len(sr):7d}/{len(dr):7d} spark={t1 - t0:5.1f}s "
              f"{'OK' if ok else 'MISMATCH'}")
        if not ok:
            if sc != dc:
                print("   cols", sc, dc)
            else:
                ss, ds = set(sr), set(dr)
                for r in list(ss - ds)[:3]:
                    print("   spark only:", r)
                for r in list(ds - ss)[:3]:
                    print("   duck  only:", r)
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf, sys.argv[2:]) else 0)
