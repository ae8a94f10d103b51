"""Runs registered queries beside their DuckDB SQL."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def difference(spark, con, run, sql, sf_dir):
    """None, or what differs."""
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    if mine != theirs:
        odd = [x for x in zip(mine, theirs, strict=False) if x[0] != x[1]][:2]
        return f"{len(mine)} and {len(theirs)} rows, first differences {odd}"
    return None
