"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

import glob
import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def _norm(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_norm, value)) + "]"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, folder=SF_DIR):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    wanted = con.sql(sql)
    got = query(spark, folder)
    columns, mine = _rows(got.columns, got.collect())
    assert (columns, mine) == _rows(wanted.columns, wanted.fetchall())
