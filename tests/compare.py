"""Comparison of a DataFrame with DuckDB's answer on the same tables."""

import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, values):
    def plain(x):
        if x is None or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, bool):
            return str(int(x))
        if isinstance(x, (int, float)):
            return repr(float(x))
        return str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(v[i]) for i in order) for v in values)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    different = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not different, different[:3]
