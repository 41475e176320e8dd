"""Every registered query with SQL gives the rows that the SQL gives."""

import math

import duckdb
import pytest

from gridpyramid.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "events embeddings lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, "")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return (1, float(value))
    return (2, str(value).replace("+00:00", ""))


def rows(found, columns):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in place) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    answer = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(answer.fetchall(), answer.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_antimeridian_takes_the_whole_lattice(spark, duck):
    rows = {r.gy for r in registry.QUERIES["mvt_antimeridian"](spark, DATA).select("gy").distinct().collect()}
    assert max(rows) >= 64 and len(rows) > 150
    assert rows == {r[0] for r in duck.sql(f"select distinct gy from ({registry.ORACLES['mvt_antimeridian']})").fetchall()}
