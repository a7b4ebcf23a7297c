"""Every registered query of the library against its SQL in DuckDB."""

import datetime

import duckdb
import pytest
from sylvan.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in frame.columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in frame.collect()) == want
