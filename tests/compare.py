"""Run a query and its SQL on the same tables and compare rows, whatever their order."""

import glob
import math
import os

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check_query(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    assert len(got) == len(want), (name, len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    assert got == want, (name, [(a, b) for a, b in zip(got, want) if a != b][:3])
