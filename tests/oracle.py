"""Compare a Spark query with its SQL counterpart, value by value, whatever the row order."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if value != value else value
    return value


def compare(spark, con, folder: str, fn, sql: str | None) -> str | None:
    """None when equal (or when there is no SQL), else a description of the difference."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(_cell(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    if sql is None:
        return "no SQL to compare with"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} vs {sorted(columns)}"
    order = [columns.index(n) for n in names]
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in cursor.fetchall())
    if ours == theirs:
        return None if ours else "EMPTY"
    extra, missing = ours - theirs, theirs - ours
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}; only spark {sum(extra.values())}: "
        f"{list(extra)[:2]}; only sql {sum(missing.values())}: {list(missing)[:2]}; columns {names}"
    )


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from trustlake.catalog import ORACLES, QUERIES
    from trustlake.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, fn, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {str(error)[:1500]}"
        tag = "ok" if result is None else "DIFF"
        bad += result is not None
        print(f"{tag:5}{name:34}{time.time() - start:6.1f}s  {'' if name in ORACLES else '(rows only) '}{result or ''}", flush=True)
    print("bad", bad)
