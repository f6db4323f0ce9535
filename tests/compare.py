"""Run queries on Spark and their SQL on DuckDB and compare the rows.

``python tests/compare.py SF_DIR [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else float(value)
    return str(value)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty text when equal, else what differs."""
    df = query(spark, sf_dir)
    result = con.sql(sql)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} <> {sorted(result.columns)}"
    ours = _rows(df.columns, df.collect())
    theirs = _rows(result.columns, result.fetchall())
    if ours == theirs:
        return ""
    left, right = ours - theirs, theirs - ours
    return (
        f"{ours.total()} <> {theirs.total()} rows; only ours {left.total()} "
        f"{list(left)[:2]}; only SQL {right.total()} {list(right)[:2]}"
    )


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from conftest import make_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    session, con = make_session(), duck(sf)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                said = compare(session, con, sf, fn, sqls[name])
            else:
                df = fn(session, sf)
                said = f"(rows only: {df.count()} rows)"
        except Exception as e:
            said = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("(rows")
        print(f"{time.time() - start:6.2f}s {name}: {said or 'ok'}", flush=True)
    print(f"{bad} differ")
