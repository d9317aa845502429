"""Compares registered queries with their SQL: python tests/verify.py FOLDER [NAME...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows_of(names: list[str], rows) -> list[tuple]:
    """Rows with columns in the order of their names, comparable and sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, con, folder: str, name: str, query, sql: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows against {len(want)}: {a} against {b}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e

    from delvework.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con, queries, sql = local_session(), duck(folder), e.queries(), e.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    for name in only or sql:
        t = time.time()
        try:
            said = compare(spark, con, folder, name, queries[name], sql[name]) if name in sql else f"{queries[name](spark, folder).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {'same' if not said else said} ({time.time() - t:.1f} s)", flush=True)
