"""Every engine query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "conversations", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in (r[k] for k in order)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
