import datetime
import decimal

import duckdb
import pytest

from sigdiff import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "part", "lineitem", "events", "supplier", "customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 3) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    cols = sorted(found.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in found.collect())
    sql = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in sql.description]
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in sql.fetchall())
    assert sorted(names) == cols and ours == theirs and ours
