"""Runs a registered query's SQL in DuckDB and compares the rows with Spark's, in any order."""

import math
import tempfile

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def duck_rows(sql, sf):
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="spark-")})
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted((tuple(_value(r[k]) for k in at) for r in found.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=repr)
