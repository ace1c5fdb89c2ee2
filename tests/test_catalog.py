"""Every registered query against its SQL, by values without regard to order."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tidewright import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, Decimal):
        return int(value) if value == int(value) else float(value)
    return value


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()]
    sql = catalog.oracle_sql()[name]
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert len(rows) == len(want)
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert rows
