"""Compare registered queries with their SQL, run as ``python tests/oracle.py <folder> [names...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """Nothing when both agree, else the first difference."""
    frame = query(spark, folder)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = _rows(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    names = {"bigint": ("BIGINT", "NUMBER"), "string": ("VARCHAR", "STRING"), "double": ("DOUBLE", "NUMBER")}
    odd = [(f, t, kinds[f]) for f, t in frame.dtypes if t in names and not any(n in kinds[f].upper() for n in names[t])]
    return f"types {odd}" if odd else None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    oracles, failed = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, query, oracles[name], folder)
            else:
                frame = query(spark, folder)
                n = len(frame.collect())
                problem = None if n else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - started:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
