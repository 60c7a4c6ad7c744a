"""Comparison of a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same_rows(df, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    columns = sorted(df.columns)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in got.fetchall()]
    have = [tuple(map(plain, row)) for row in df.select(*columns).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
