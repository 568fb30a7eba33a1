"""Run registered queries against DuckDB on the same files and compare values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([_value(x) for x in v])
    return str(v)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    actual = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected = normalized([d[0] for d in result.description], result.fetchall())
    return actual, expected


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from descry.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), []
    sqls = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {query(spark, folder).count()} rows, no SQL")
                continue
            actual, expected = compare(spark, con, query, sqls[name], folder)
            ok = actual == expected
            print(f"{'ok  ' if ok else 'DIFF'} {name} {len(actual[1])} rows {time.time() - start:.1f}s")
            if not ok:
                failed.append(name)
                print("  columns", actual[0], expected[0], len(expected[1]))
                a, b = set(actual[1]), set(expected[1])
                print("  only spark ", [str(x)[:1500] for x in sorted(a - b)[:2]])
                print("  only duckdb", [str(x)[:1500] for x in sorted(b - a)[:2]])
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: {str(e)[:1500]}")
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
