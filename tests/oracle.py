"""Compare registered queries with their SQL: `python tests/oracle.py [sf] [query ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both results are equal, else a short account of the first difference."""
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    got_rows = df.collect()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got, want = _sorted_rows(df.columns, got_rows), _sorted_rows(want_names, want_rows)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{repr(a)[:400]} != {repr(b)[:400]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from razao.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = local_session("8", "razao-oracle"), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            diff = difference(queries[name](spark, sf_dir), con, sql[name])
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
