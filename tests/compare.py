"""Run named queries on Spark and their SQL twins on DuckDB, and compare whole results.

    python tests/compare.py [folder of test tables] [query names ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return v


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, text: str) -> str | None:
    mine = spark_df.collect()
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} <> {sorted(names)}"
    a, b = rows_of(spark_df.columns, mine), rows_of(names, theirs)
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} <> {len(b)}; only Spark {only_a}; only SQL {only_b}; columns {sorted(names)}"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from fairload.session import get_or_create

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_or_create(
        "compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                found = differences(df, con, oracle[name])
                label = "same" if found is None else "DIFF " + found
            else:
                found, label = None, f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found, label = error, f"FAIL {type(error).__name__} {str(error)[:900]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - began:6.2f}s {label}", flush=True)
    print("not the same:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
