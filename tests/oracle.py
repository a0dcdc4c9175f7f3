"""Holding a query against the SQL that states its result."""

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    return sorted(df[columns].astype(str).itertuples(index=False, name=None)), columns


def check(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(query(spark, sf_dir).toPandas()) == rows(con.sql(sql).df()), name
