"""Run queries on Spark and their SQL on DuckDB and compare the rows.

Usage: python tests/compare.py [data folder] [key prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value: object) -> object:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())


def compare(spark, con, sf_dir: str, key: str, query, sql: str | None) -> str:
    names, rows = spark_rows(query(spark, sf_dir))
    if sql is None:
        return f"rows-only {len(rows)}"
    names2, rows2 = duck_rows(con, sql)
    if names != names2:
        return f"COLUMNS {names} / {names2}"
    if rows != rows2:
        left = [r for r in rows if r not in set(rows2)][:2]
        right = [r for r in rows2 if r not in set(rows)][:2]
        return f"VALUES {len(rows)} / {len(rows2)} spark {left} sql {right}"
    return f"ok {len(rows)}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from riskpanel.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for key, query in queries().items():
        if args and not any(key.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, key, query, sqls.get(key))
        except Exception as error:  # report every key, also broken ones
            verdict = "ERROR " + str(error).strip()[:700]
            if "-v" in args:
                traceback.print_exc()
        if not verdict.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{key:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
