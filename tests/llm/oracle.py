"""Compare a query with its SQL on tables of a folder."""

import math
from pathlib import Path

import duckdb


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.sql(sql)
    names = sorted(want.columns)
    df = query(spark, str(folder))
    assert sorted(df.columns) == names
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)
    got = tidy(tuple(r) for r in df.select(*names).collect())
    expected = tidy(want.select(*names).fetchall())
    assert got == expected
    return got
