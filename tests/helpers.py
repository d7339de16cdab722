"""A query against its SQL."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def compare(spark, sf_dir: str, run, sql: str) -> None:
    """A query against its SQL: the same columns and rows, in any order."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]

    def plain(v):
        return "null" if v is None else f"{float(v):.9g}" if isinstance(v, float) else str(v)

    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    expected = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert got == expected
