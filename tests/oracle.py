"""Runs registered queries beside their SQL, as a driver would: columns by name, rows in any order."""

import glob
import os
from decimal import Decimal

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, Decimal):
        return float(value)
    return None if value is None or value is pd.NaT else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, connection, run, sql, sf_dir):
    """None if equal, else what differs."""
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} for {want[0]}"
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in want[1]][:2], [r for r in want[1] if r not in got[1]][:2]
        return f"{len(got[1])} rows for {len(want[1])}; only here {only[0]}, only there {only[1]}"
    return None
