"""Compare registered queries with their SQL on the same Parquet tables."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark: SparkSession, con, sf: str, fn, sql: str) -> str:
    """Empty when both sides give the same columns and rows, else what differs."""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a == b:
        return ""
    names = sorted(cols)
    return (f"rows {len(got)} vs {len(want)}, differing {sum((a - b).values())}; columns {names}\n"
            f"   spark  {sorted((a - b).elements())[:2]}\n   sql    {sorted((b - a).elements())[:2]}")


def main(sf: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from opinara.session import local_session
    from opinara.workload import ORACLES, QUERIES

    spark, con, bad = local_session(8), connect(sf), 0
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                text = difference(spark, con, sf, fn, ORACLES[name])
            else:
                text = "" if fn(spark, sf).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(text)
        print(f"{'FAIL' if text else 'ok  '} {time.time() - start:6.2f}s {name} {text}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
