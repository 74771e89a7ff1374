"""Runs queries against their SQL in DuckDB: python tests/oracle.py DIR [NAME...]."""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(([plain(x) for x in r] for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """Empty if both give the same rows, else what differs."""
    names, got = rows_of(query(spark, sf_dir).toPandas())
    want_names, want = rows_of(con.execute(sql).df())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/oracle-shared").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    where, only = sys.argv[1], sys.argv[2:]
    found, sql, con = entry.queries(), entry.oracle_sql(), duck(sys.argv[1])
    for name, query in found.items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            if name in sql:
                said = compare(session, con, where, query, sql[name]) or "same"
            else:
                rows = query(session, where).collect()
                said = f"{len(rows)} rows, no SQL: {rows[:1]}"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__} {str(e)[:1500]}"
        print(f"{name}: {said[:1800]} ({time.time() - began:.1f} s)", flush=True)
