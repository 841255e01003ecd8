"""Results of a query beside those of its SQL, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
