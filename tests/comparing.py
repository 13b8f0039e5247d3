"""Rows of a Spark result and of its SQL, in one comparable form."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in cur.fetchall()), key=str)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con
