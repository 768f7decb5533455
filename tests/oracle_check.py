"""Run registered queries against their DuckDB twins (like the driver does).

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidelink.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    return v


def frame_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_pdf = pd.DataFrame(sdf.collect(), columns=sdf.columns)
    t1 = time.time()
    d_pdf = con.sql(sql).df()
    sc, sr = frame_rows(s_pdf)
    dc, dr = frame_rows(d_pdf)
    ok = sc == dc and sr == dr
    detail = ""
    if not ok:
        if sc != dc:
            detail = f"cols {sc} vs {dc}"
        else:
            sset, dset = set(sr), set(dr)
            detail = (f"rows {len(sr)} vs {len(dr)}; only spark {list(sset - dset)[:3]}; "
                      f"only duck {list(dset - sset)[:3]}")
    return ok, len(sr), t1 - t0, detail


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as entry
    from tidelink.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if only and key not in only:
            continue
        if key not in sqls:
            n = fn(spark, sf_dir).count()
            print(f"ROWS-ONLY {key}: {n} rows")
            continue
        try:
            ok, n, secs, detail = compare(spark, con, key, fn, sqls[key], sf_dir)
        except Exception as exc:  # report and continue
            ok, n, secs, detail = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {key}: {n} rows {secs:.1f}s {detail}")
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
