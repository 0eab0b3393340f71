"""Run queries and their checking SQL side by side.

``python tests/oracle.py [sf] [name…]`` checks the named queries, or all.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def compare(spark, sf_dir: str, fn, sql: str) -> str | None:
    """None if both give the same, else what differs."""
    df = fn(spark, sf_dir)
    con = connect(sf_dir)
    con.execute(sql)
    want_cols, want = rows_of([c[0] for c in con.description], con.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        for a, b in zip(g, w):
            if isinstance(a, str) and isinstance(b, str) and a != b:
                i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                return f"{len(bad)} rows differ, e.g. key {g[:1]!r:.40} at {i}: {a[max(0, i-30):i+30]!r} != {b[max(0, i-30):i+30]!r}"
        return f"{len(bad)} of {len(got)} rows differ, e.g. {str(g)[:300]} != {str(w)[:300]}"
    return None


def main() -> None:
    from conftest import make_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, f"{DATA}/sf{sf}", fn, oracles[name])
            else:
                problem = None if fn(spark, f"{DATA}/sf{sf}").count() else "no rows"
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.1f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
