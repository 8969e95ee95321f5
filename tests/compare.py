"""Rows of a Spark query and of its SQL in DuckDB in one form."""

import math
from functools import cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@cache
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def assert_same(df, sql, sf):
    r = duck(sf).execute(sql)
    columns = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in r.description}
    assert dict(df.dtypes) == columns
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row, strict=True))]) for row in r.fetchall())
    got = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert got == want
