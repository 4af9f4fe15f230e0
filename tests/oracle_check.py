"""Compare every registered query with its SQL in DuckDB: ``python tests/oracle_check.py [folder] [names]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime.datetime)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    number = float(value)
    if math.isnan(number):
        return "NaN"
    return number + 0.0 if number else 0.0


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql: str, folder: str) -> str | None:
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    theirs = rows_of(names, cursor.fetchall())
    if mine == theirs:
        return None
    return (
        f"{sum(mine.values())} rows against {sum(theirs.values())}; "
        f"only Spark {list((mine - theirs))[:3]}; only SQL {list((theirs - mine))[:3]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    from workload import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in ORACLES:
                found = differences(spark, con, QUERIES[name], ORACLES[name], folder)
                note = "ok" if found is None else f"DIFFERS: {found}"
            else:
                note = f"rows only: {len(QUERIES[name](spark, folder).collect())}"
        except Exception as error:  # noqa: BLE001
            note = f"FAILED: {type(error).__name__}: {str(error)[:600]}"
        bad += not note.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
