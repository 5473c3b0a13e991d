"""Run queries beside their oracle SQL and compare the rows.

    python tests/compare.py SF_DIR [name or prefix* ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def difference(columns, left, right):
    """None when equal, else a short text; doubles must agree to 1e-9 relative."""
    if len(left) != len(right):
        return f"{len(left)} rows, oracle {len(right)}"
    inexact = 0
    for a, b in zip(left, right):
        for c, x, y in zip(columns, a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float):
                if math.isnan(x) and math.isnan(y):
                    continue
                if math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    inexact += 1
                    continue
            return f"{c}: {a} != {b}"
    return f"inexact {inexact}" if inexact else None


def run(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    return len(got), difference(sorted(names), rows_of(df.columns, got), rows_of(names, want))


def main(sf: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, oracles = connect(sf), 0, oracle_sql()
    match = lambda n: not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)
    for name, fn in queries().items():
        if not match(name):
            continue
        start = time.time()
        try:
            rows, problem = run(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {kind:6s} {rows:8d} rows {time.time() - start:6.2f}s "
              f"{problem or ''}", flush=True)
    spark.stop()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
