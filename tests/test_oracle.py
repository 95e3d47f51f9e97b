"""Every query of the library against its SQL twin in DuckDB."""

import datetime
import math

import duckdb
import pytest

from tracelink.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    r = con.execute(SQL[name])
    order = [d[0] for d in r.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(row[order.index(c)]) for c in names) for row in r.fetchall()), key=str)
    assert got == want


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name, branch, values", [("b8_search_place", None, None), ("d5_clusters_at", None, None), ("d6_attributes_at", None, None), ("d15_link_by_criteria", "criterion", {"one", "both"}), ("d19_resolve_locations", "step", {0, 1, 2})])
def test_no_branch_is_empty(con, name, branch, values):
    found = con.execute(f"SELECT DISTINCT {branch or 1} FROM ({SQL[name]})").fetchall()
    assert {r[0] for r in found} == (values or {1})
