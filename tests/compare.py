"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

``python tests/compare.py [sf_dir] [key or prefix* …]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return str(value)
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str, clock: list) -> str | None:
    """None if equal, else a short description."""
    rows = [tuple(r) for r in spark_df.collect()]
    clock.append(time.time())
    left = rows_of(spark_df.columns, rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = rows_of(names, cur.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if left == right:
        return None if left else "both empty"
    only_l = sorted(set(left) - set(right))[:3]
    only_r = sorted(set(right) - set(left))[:3]
    return f"{len(left)} / {len(right)} rows; spark only {only_l}; sql only {only_r}"


def main() -> int:
    import __spark_entry__ as entry
    from sparkloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    if os.environ.get("PLAIN_SESSION"):  # Spark's defaults and another time zone
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config(
            "spark.sql.session.timeZone", "America/New_York").config("spark.driver.memory", "8g").config(
            "spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for key, run in entry.queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        start, clock = time.time(), []
        try:
            df = run(spark, sf_dir)
            if key in sql:
                problem = differences(df, con, sql[key], clock)
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} spark {(clock or [time.time()])[0] - start:.1f}s total {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
