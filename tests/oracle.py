"""Compares a query's rows with those of its SQL, as sorted values; numbers may differ by rounding errors of sums, not by a digit."""

import glob
import math
import os

import duckdb


def same_rows(df, sql, folder, digits=9):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, digits) + 0.0
        return v

    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(plain(v) for v in r) for r in want.select(*cols).fetchall()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 10**-digits * max(1, abs(v))), (x, y)
