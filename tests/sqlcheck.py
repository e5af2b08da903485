"""Runs a query and its SQL side by side and compares rows whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return str(round(float(v), 9)) if isinstance(v, int | float) else str(v)


def both(spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    theirs = sorted(tuple(cell(r[cols.index(n)]) for n in names) for r in cur.fetchall())
    return mine, theirs
