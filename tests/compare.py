"""Compare registered queries with their check texts: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("documents", "events", "conversations", "benchmark", "labels", "pages")


def check_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, list):
        return "[" + ",".join(str(normal(v)) for v in value) + "]"
    return "NULL" if value is None else str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir: str, run, sql: str | None) -> tuple[int, str]:
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), ""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return len(got), f"{len(got)} / {len(want)} rows; spark {only_got}; check {only_want}"
    return len(got), ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from treeweave.session import build_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = check_engine(sf_dir)
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            count, problem = differences(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:
            count, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        state = "OK " if not problem and name in sqls else "rows" if not problem else "BAD"
        print(f"{state} {name} rows={count} {time.time() - begin:.2f}s {problem}", flush=True)
