"""Runs registered queries against their DuckDB statements and compares rows exactly."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def rows_of(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(name: str, spark_df, con, statement: str) -> str | None:
    """None when equal, else the first difference."""
    got = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not got:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first {dict(zip(sorted(names), zip(*bad[0])))}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from duelbook.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, statements = duck(folder), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in statements:
                outcome = compare(name, fn(spark, folder), con, statements[name]) or "ok"
            else:
                outcome = f"rows {fn(spark, folder).count()}"
        except Exception as error:  # keep going: the list of outcomes is the point
            outcome = f"ERROR {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {outcome}", flush=True)


if __name__ == "__main__":
    main()
