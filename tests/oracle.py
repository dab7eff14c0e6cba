"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """One form for values of both engines."""
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, sql: str, con) -> tuple[int, list[str]]:
    """Row count of the query and the differences found."""
    rows = df.collect()
    found = con.execute(sql)
    sql_columns = [c[0] for c in found.description]
    sql_rows = found.fetchall()
    problems = []
    if sorted(df.columns) != sorted(sql_columns):
        return len(rows), [f"columns {sorted(df.columns)} vs {sorted(sql_columns)}"]
    order = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    at = [sql_columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in sql_rows), key=repr)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows vs {len(theirs)}")
    for a, b in zip(mine, theirs):
        if a != b:
            problems.append(f"first difference {order}: {str(a)[:400]} vs {str(b)[:400]}")
            break
    return len(rows), problems


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from feedcore.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                count, problems = compare(df, oracles[name], con)
            else:
                count, problems = df.count(), []
        except Exception as error:  # a report, not a handler
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        mark = "ok " if not problems else "BAD"
        print(f"{mark} {name:24} {count:8} rows {time.time() - start:6.2f}s", *problems, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
