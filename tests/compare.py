"""Run queries and their SQL side by side: python -m tests.compare FOLDER [NAME...]."""

import os
import sys
import tempfile
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return list(map(value, x)) if isinstance(x, (list, tuple)) else x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(value(r[i]) for i in order) for r in found], key=repr)


def compare(spark, folder, run, sql):
    df = run(spark, folder)
    mine = rows(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    theirs = rows(names, want.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not odd, odd[:2]
    return len(mine)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, sql in entry.oracle_sql().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            began = time.time()
            try:
                said = f"{compare(spark, sys.argv[1], entry.queries()[name], sql)} rows equal"
            except Exception as e:
                said = "DIFFERS " + str(e)[:600].replace("\n", " ")
            print(f"{name}: {said}, {time.time() - began:.1f} s", flush=True)
