"""Compare registered queries with their SQL counterparts: column names, row count and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (1, repr(value))
    if hasattr(value, "isoformat"):
        return (1, value.isoformat())
    return (1, str(value))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in records)


def compare(df, con, sql: str):
    """None when equal, else a short text that tells the difference."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    theirs_types = dict(con.execute(f"select column_name, column_type from (describe {sql})").fetchall())
    for name, kind in df.dtypes:
        if SQL_TYPES.get(kind) != theirs_types[name]:
            return f"type of {name}: {kind} != {theirs_types[name]}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a}\n   != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from touchline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            told = compare(query(spark, sf_dir), con, oracles[name]) if name in oracles else "no SQL"
        except Exception as error:  # keep going: the report names every failure
            told = f"{type(error).__name__}: {str(error)[:600]}"
        failed += told is not None
        print(f"{name:32s} {time.time() - started:6.2f}s {'ok' if told is None else told}", flush=True)
    print(f"{failed} differ")
