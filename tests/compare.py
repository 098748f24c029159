"""Run a query and its SQL over the same tables and report how they differ."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def difference(spark, name, query, sql, sf_dir) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} and {len(want[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{name}: {len(odd)} of {len(got[1])} rows differ, first {str(odd[0])[:600]}" if odd else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    from quillrank.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    sql = e.oracle_sql()
    for n, q in e.queries().items():
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            said = difference(spark, n, q, sql[n], f"/root/testdata/{sf}") if n in sql else f"{n}: no SQL, {q(spark, f'/root/testdata/{sf}').count()} rows"
        except Exception as x:
            said = f"{n}: {type(x).__name__} {str(x)[:1500]}"
        print(f"{time.time() - t:6.1f} s  {said or n + ': equal'}", flush=True)
