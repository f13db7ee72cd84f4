"""Local correctness check: run registered Spark queries and their DuckDB SQL on
the same parquet tables and compare columns, row counts and values.

    python tools/oracle_check.py [--sf-dir DIR] [name ...]

Floats are compared exactly (``ORACLE_STRICT=0`` compares 9 significant
digits); ``ORACLE_DTYPES=1`` also reports numeric width differences between the
two result frames (int32 vs int64 and the like).
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tapestry.plans import queries as Q  # noqa: E402
from tapestry.session import local_session  # noqa: E402


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "<NULL>"
    try:
        if v != v:  # NaN / NaT
            return "<NULL>"
    except Exception:
        pass
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "<NULL>"
        return repr(f) if STRICT else f"{f:.9g}"
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return str(v)


STRICT = os.environ.get("ORACLE_STRICT", "1") == "1"


def kinds(pdf):
    out = {}
    for c in pdf.columns:
        k = pdf[c].dtype.kind
        if k == "O":
            vals = [v for v in pdf[c] if v is not None and v is not pd.NA and not (isinstance(v, float) and v != v)]
            k = type(vals[0]).__name__ if vals else "null"
        if os.environ.get("ORACLE_DTYPES") == "1" and k in "iufb":
            out[c] = str(pdf[c].dtype).lower()
            continue
        out[c] = {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time", "bool": "bool", "str": "str",
                  "int": "int", "float": "float", "Decimal": "decimal", "date": "date", "datetime": "time"}.get(k, k)
    return out


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    qs, sqls = Q.queries(), Q.oracle_sql()
    names = a.names or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sp = qs[n](spark, a.sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"ROWS {n}: {len(sp)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            dd = con.execute(sqls[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        if c1 != c2:
            print(f"FAIL {n}: columns spark={c1} oracle={c2}")
            bad += 1
            continue
        if r1 != r2:
            bad += 1
            s1, s2 = set(r1), set(r2)
            print(f"FAIL {n}: rows spark={len(r1)} oracle={len(r2)}; only-spark={len(s1 - s2)} only-oracle={len(s2 - s1)}")
            for x in sorted(s1 - s2)[:3]:
                print("   spark :", dict(zip(c1, x)))
            for x in sorted(s2 - s1)[:3]:
                print("   oracle:", dict(zip(c2, x)))
            continue
        k1, k2 = kinds(sp), kinds(dd)
        diff = {c: (k1[c], k2[c]) for c in k1 if k1[c] != k2.get(c) and "null" not in (k1[c], k2.get(c))}
        note = f"  TYPES {diff}" if diff else ""
        print(f"OK   {n}: {len(r1)} rows {ts:.1f}s{note}")
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
