"""Every warehouse query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from shared_rows import SF
from leaselake.plans.queries import QUERIES, SQL
from leaselake.shipping import ship


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_each_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    ship(spark)
    got = QUERIES[name](spark, SF)
    wanted = tables.execute(SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is not None, x or "") for x in r)
    ours = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in wanted.fetchall()), key=key)
    assert len(ours) > 0
    assert ours == theirs
