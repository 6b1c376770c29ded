"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Compares row count, column names and an order-insensitive hash of values
(doubles rounded to 6 places).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, bool):
        return str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), [columns[i] for i in order], h, lines


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            s = digest(sdf.columns, srows)
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name])
            continue
        t1 = time.time()
        if name not in sqls:
            out[name] = f"rows-only {s[0]}"
            if verbose:
                print(f"{name:28s} rows-only rows={s[0]} spark={t1 - t0:.2f}s")
            continue
        try:
            res = con.execute(sqls[name])
            cols = [d[0] for d in res.description]
            o = digest(cols, [tuple(r) for r in res.fetchall()])
        except Exception as e:  # noqa: BLE001
            out[name] = f"ORACLE ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name])
            continue
        ok = s[:3] == o[:3]
        out[name] = "match" if ok else "MISMATCH"
        if verbose:
            print(f"{name:28s} {'OK ' if ok else 'BAD'} rows spark={s[0]} oracle={o[0]} "
                  f"spark={t1 - t0:.2f}s oracle={time.time() - t1:.2f}s")
            if not ok:
                if s[1] != o[1]:
                    print("   cols spark ", s[1])
                    print("   cols oracle", o[1])
                a, b = set(s[3]), set(o[3])
                for x in sorted(a - b)[:4]:
                    print("   spark only :", x[:300])
                for x in sorted(b - a)[:4]:
                    print("   oracle only:", x[:300])
    return out


if __name__ == "__main__":
    from noteflare.session import build_local

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_local()
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v not in ("match",) and not v.startswith("rows-only")}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("  ", k, v)
