"""Run registered queries against their SQL check and report differences.

Usage: python -m tests.compare [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

from fleetlens.plans.registry import TABLE_NAMES

SF_DIR = os.environ.get("FLEETLENS_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")),
                  round(v, 6) if isinstance(v, float) else v if isinstance(v, int) else str(v)) for v in row)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=sort_key)


def same(a, b) -> bool:
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return False


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short description."""
    cols, rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    dcols, drows = table([d[0] for d in cur.description], cur.fetchall())
    if cols != dcols:
        return f"columns {cols} != {dcols}"
    if len(rows) != len(drows):
        return f"rows {len(rows)} != {len(drows)}; first {rows[:2]} / {drows[:2]}"
    loose = 0
    for a, b in zip(rows, drows):
        for name, x, y in zip(cols, a, b):
            if not same(x, y):
                return f"{name}: {x!r} != {y!r}; row {a} / {b}"
            if x != y or (isinstance(x, float) != isinstance(y, float)):
                loose += 1
    if loose:
        print(f"      note: {loose} values equal only within tolerance or by number type")
    if not rows:
        return "no rows"
    return None


def main(prefixes: list[str]) -> int:
    from fleetlens.session import local_session
    import __spark_entry__ as entry
    spark = local_session(8)
    con = duck()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(fn(spark, SF_DIR), con, oracles[name])
            else:
                n = fn(spark, SF_DIR).count()
                problem = None if n else "no rows"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:900]
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:40s} {time.time() - start:5.1f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
