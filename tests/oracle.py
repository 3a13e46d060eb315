"""Rows of a query and of its SQL, in one comparable form."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return [plain(v) for v in value] if isinstance(value, list) else value


def same_rows(df, con, sql):
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    theirs = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs))
