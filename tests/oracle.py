"""Run queries beside their SQL: python tests/oracle.py FOLDER [NAME...]."""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = normal(rel.fetchall(), names)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    assert len(got) == len(want) and not bad, (name, len(got), len(want), bad[:3])
    return len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", "/tmp/wh").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql, names = e.oracle_sql(), sys.argv[2:] or [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    for n in names:
        t = time.time()
        try:
            out = compare(spark, n, e.queries()[n], sql[n], sys.argv[1]) if n in sql else f"rows {len(e.queries()[n](spark, sys.argv[1]).collect())}"
            print("ok", n, out, round(time.time() - t, 1), flush=True)
        except Exception as x:
            print("BAD", n, str(x)[:600], flush=True)
