"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf0.01] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    clean = (tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False))
    return sorted(clean, key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    left, right = sorted(spark_frame.columns), sorted(sql_frame.columns)
    if left != right:
        return f"columns differ: only Spark {sorted(set(left) - set(right))}, only SQL {sorted(set(right) - set(left))}"
    if len(spark_frame) != len(sql_frame):
        return f"rows differ: Spark {len(spark_frame)}, SQL {len(sql_frame)}"
    spark_frame, sql_frame = spark_frame[left].astype(object), sql_frame[left].astype(object)
    a, b = rows(spark_frame), rows(sql_frame)
    if a == b:
        return None
    for x, y in zip(a, b):
        if x != y:
            return f"first difference: {[(c, u, v) for c, u, v in zip(left, x, y) if u != v][:6]} in {x[:6]}"
    return "values differ"


if __name__ == "__main__":
    from clickloom.session import get_session

    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"{TESTDATA}/{scale}"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    connection = oracle_connection(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sql:
                problem = difference(got, connection.execute(sql[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        status = "ok" if problem is None else "FAIL"
        print(f"{status:5}{name:28}{took:7.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
