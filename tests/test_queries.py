"""The library's own queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from loomery.plans import catalogue
from loomery.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = sorted(catalogue.oracle_sql())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    wanted = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]})").fetchall()), key=str)
    assert found == wanted


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
