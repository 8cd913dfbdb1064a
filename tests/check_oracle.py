"""Run registered queries and their SQL side by side: python tests/check_oracle.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) > 1e9 else f"{round(value, 4):.4f}"
    if isinstance(value, int):
        return str(value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, build, sql):
    started = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL", took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}", took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows equal", took
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return False, f"rows {len(a)} / {len(b)}\n   {sorted(names)}\n   spark {only_a}\n   sql   {only_b}", took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    # a session with nothing set, as a stranger would bring it
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            good, note, took = compare(spark, con, sf_dir, name, build, oracle.get(name))
        except Exception as error:  # report and go on
            good, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += [] if good else [name]
        print(f"{'ok  ' if good else 'FAIL'} {name:28s} {took:6.1f}s  {note}", flush=True)
    print("failed:", failed)
