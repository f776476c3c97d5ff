"""Registered queries against their SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from cardloom.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.SQL)


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0  # one zero
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return int(value) if isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == want
