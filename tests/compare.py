"""Run the catalogue next to its SQL and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    s_cols, s_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in found.description], found.fetchall())
    if s_cols != d_cols:
        return [f"columns {set(s_cols) ^ set(d_cols)}"]
    out = []
    if len(s_rows) != len(d_rows):
        out.append(f"rows {len(s_rows)} != {len(d_rows)}")
    types = {c: (type(a).__name__, type(b).__name__) for r, d in zip(s_rows, d_rows) for c, a, b in zip(s_cols, r, d)
             if a is not None and b is not None and type(a) is not type(b)}
    if types:
        out.append(f"types {types}")
    wrong = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    for a, b in wrong[:limit]:
        out.append(str({c: (x, y) for c, x, y in zip(s_cols, a, b) if x != y}))
    return out + ([f"{len(wrong)} rows differ"] if wrong else [])


def main(sf_dir: str, *names: str) -> None:
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from clientpulse.session import build_session

    spark = build_session(
        "compare",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problems = differences(df, con, oracle[name]) if name in oracle else []
            state = ("ok" if not problems else "DIFF") if name in oracle else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problems, state = [f"{type(error).__name__}: {str(error)[:600]}"], "ERROR"
        bad += bool(problems)
        print(f"{name}: {state} {time.time() - start:.1f}s", *problems, sep="\n    ", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(*sys.argv[1:])
