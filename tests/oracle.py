"""Run a query and its SQL over the same tables and compare rows without order."""

import datetime
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def rows(table, columns):
    def text(v):
        if isinstance(v, datetime.datetime):
            return str(v.replace(tzinfo=None))
        return f"{v:.9g}" if isinstance(v, float) else repr(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in table.to_pylist())


def duck(sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con.sql(sql).to_arrow_table()


def check(spark, run, sql):
    got, want = run(spark, DATA).toArrow(), duck(sql)
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)
