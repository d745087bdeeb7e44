"""Spark rows against DuckDB's, columns by name, order left out."""

import glob
import math
import os

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, order, rows):
    at = [order.index(n) for n in names]
    return sorted(repr(tuple(normal(r[i]) for i in at)) for r in rows)


def duck(sf_dir, sql):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = connection.sql(sql)
    return found.columns, found.fetchall()


def same(df, sf_dir, sql):
    columns, wanted = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert rows_of(names, df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, columns, wanted)
