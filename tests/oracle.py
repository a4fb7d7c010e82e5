"""Run registered queries next to their SQL twins.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value, digits: int | None = None):
    """Comparable form of a cell; floats exact unless ``digits`` is given."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if digits is None else float(f"%.{digits}g" % value) + 0.0
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v, digits) for v in value)
    return value


def rows_of(columns: list[str], rows, digits: int | None = None) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i], digits) for i in order) for row in rows]
    return sorted(table, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, folder: str, con, query, sql: str) -> tuple[str, int, float]:
    started = time.time()
    frame = query(spark, folder)
    ours = [tuple(r) for r in frame.collect()]
    seconds = time.time() - started
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"COLUMNS {sorted(set(frame.columns) ^ set(names))}", len(ours), seconds
    if len(ours) != len(theirs):
        return f"ROWS {len(ours)} != {len(theirs)}", len(ours), seconds
    a, b = rows_of(frame.columns, ours), rows_of(names, theirs)
    if a == b:
        return "ok", len(ours), seconds
    a9, b9 = rows_of(frame.columns, ours, 9), rows_of(names, theirs, 9)
    differing = [(x, y) for x, y in zip(a9, b9) if x != y]
    if not differing:
        return "ok (9 digits)", len(ours), seconds
    return f"VALUES {len(differing)}: {sorted(names)} {differing[0][0]} | {differing[0][1]}", len(ours), seconds


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from intertie.queries import load
    from intertie.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    registry = load()
    unknown = set(registry.sql) - set(registry.queries)
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                            "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failures = len(unknown)
    for name, query in registry.queries.items():
        module = query.__module__.rsplit(".", 1)[-1]
        if wanted and not any(w in name or w == module for w in wanted):
            continue
        try:
            if name in registry.sql:
                status, rows, seconds = compare(spark, folder, con, query, registry.sql[name])
            else:
                started = time.time()
                rows = len(query(spark, folder).collect())
                status, seconds = "rows only", time.time() - started
        except Exception as error:  # noqa: BLE001 - report and go on
            status, rows, seconds = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0, 0.0
        failures += not status.startswith(("ok", "rows only"))
        print(f"{name:34s} {rows:8d} {seconds:6.2f}s {status}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main())
