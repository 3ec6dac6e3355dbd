"""Every registered query of the notice engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from noticelake import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(f"select * from ({sql})")
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(rows) == plain(duck.sql(f"select {quoted} from ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_custkey", "code", "km", "azimuth", "passed_over"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
