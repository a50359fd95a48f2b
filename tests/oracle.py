"""A query's rows and its SQL's rows, side by side."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = query(spark, str(DATA))
    columns = sorted(got.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert ours == theirs
