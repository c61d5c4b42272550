"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import re

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES
from tidemark.plans.fixtures import GIVEN, TABLES, needs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in GIVEN:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.select(*(f"`{c}`" for c in columns)).collect()), key=repr) == expected


def test_tables_name_only_tables():
    for name in TABLES:
        assert all(n in TABLES or n in GIVEN for n in needs(name)), name
    assert all(re.fullmatch(r"[a-z]+\d\d_\w+", n) for n in QUERIES)
