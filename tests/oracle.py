"""Compare a query with its SQL in DuckDB."""

import duckdb

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    def plain(v):
        if v is None or v != v:
            return "none"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


def same(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns), name
    assert len(ours) == len(theirs), name
    assert rows_of(ours, columns) == rows_of(theirs, columns), name
