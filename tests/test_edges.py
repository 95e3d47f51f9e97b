"""Nulls, ties, repeated rows, empty tables and clashing extra columns in the library's operators."""

import pytest
from pyspark.sql import functions as F

from tracelink.functions import text as fx
from tracelink.operators import aggregate as a
from tracelink.operators import graph as g
from tracelink.operators import joins as j
from tracelink.operators import linkage as k
from tracelink.operators import ranking as r
from tracelink.operators import updates as u

IDS = "record_id long, attribute string, value string, n long, component long, step int"


@pytest.fixture
def idents(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (2, "a", None), (3, "a", None), (None, "a", "x"), (4, "b", "x"), (5, "a", "long " * 5000), (6, "a", "long " * 5000), (7, None, "y"), (8, None, "y")]
    return spark.createDataFrame([(*row, 9, 9, 9) for row in rows], IDS)


def groups(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.cluster_id, set()).add(row.record_id)
    return out


@pytest.mark.parametrize("rows", [1, 3, 200_000])
def test_rules(spark, idents, rows):
    got = groups(k.link_best_match(idents, chunk_rows=rows))
    assert got[1] == {1, 2} and got[4] == {4} and got[5] == {5, 6} and 3 not in got and None not in got
    assert groups(k.link_by_seed(idents, ["a"], 1, chunk_rows=rows))[1] == {1, 2}
    for empty in (k.link_best_match(idents.limit(0), rows), k.link_by_seed(idents.limit(0), ["a"], chunk_rows=rows)):
        assert empty.count() == 0 and empty.columns == ["cluster_id", "record_id"]


def test_incremental_without_old_or_new(spark, idents):
    none = spark.createDataFrame([], "cluster_id long, record_id long")
    assert groups(u.link_incremental(idents, none, idents.limit(0)))[1] == {1, 2}
    old = k.link_best_match(idents)
    assert groups(u.link_incremental(idents.limit(0), old, idents)) == groups(old)


def test_primary_secondary_without_keys(spark):
    df = spark.createDataFrame([(1, None, "x", 0), (2, "p", "x", 0), (2, "p", "x", 0), (3, "q", None, 0)], "record_id long, p string, s string, group long")
    assert groups(k.link_primary_secondary(df.drop("group"), "p", "s")) == {2: {2}, 3: {3}}


def test_bins(spark):
    rows = [(5, [0, 0], 1), (3, [0, 0], 1), (7, [0, 4], 1), (8, [0, 8], 1), (9, None, 1), (3, [0, 0], 1), (11, [0, 12], 1)]
    df = spark.createDataFrame(rows, "item_id long, hash array<int>, bin long")
    got = sorted({(x.item_id, x.bin) for x in k.bin_fingerprints(df.drop("bin"), 5).collect()})
    assert got == [(3, 3), (5, 3), (7, 3), (8, 8), (11, 8)]
    assert k.bin_fingerprints(df.drop("bin").limit(0), 5).count() == 0
    far = spark.createDataFrame([(i, [100 * i]) for i in range(4)], "item_id long, hash array<int>")
    assert {(x.item_id, x.bin) for x in k.bin_fingerprints(far, 5).collect()} == {(i, i) for i in range(4)}


def test_rings_through_values(spark):
    values = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "x", 0), (2, "a", "y", 0), (3, "a", "y", 0), (3, "b", "z", 0), (4, "c", "z", 0), (5, "a", None, 0), (6, "a", None, 0), (2, "a", "x", 0)], "cluster_id long, attribute string, value string, ring int")
    seeds = spark.createDataFrame([(1,), (1,), (5,)], "node long")
    assert {x.node: x.ring for x in g.expand_rings_by_values(seeds, values, 5).collect()} == {1: 0, 5: 0, 2: 1, 3: 2}
    assert {x.node: x.ring for x in g.expand_rings_by_values(seeds, values, 5, cap=3).collect()} == {1: 0, 5: 0, 2: 1}
    assert g.expand_rings_by_values(seeds.limit(0), values, 3).count() == 0
    shown = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {tuple(x) for x in g.link_reasons(shown, values).collect()} == {(2, 1, "x"), (3, 2, "y")}
    assert {tuple(x) for x in j.expand_existing(spark.createDataFrame([(1,)], "cluster_id long"), values).collect()} == {(1, 2, "a", "x")}


def test_communities_that_do_not_settle(spark):
    pair = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (None, 1, 1.0)], "src long, dst long, weight double")
    got = {x.node: (x.community, x.settled) for x in g.communities(pair, 4).collect()}
    assert set(got) == {1, 2} and not any(s for _, s in got.values())  # two nodes that swap labels
    assert g.communities(pair.limit(0)).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(200)], "record_id long, v int")
    got = {x.record_id: x.position for x in r.numbered(df, r.record_order(df, "v"), "record_id").collect()}
    want = sorted(range(200), key=lambda i: (not i % 5, -(i % 3) if i % 5 else 0, i))
    assert [got[i] for i in want] == list(range(1, 201))
    assert r.numbered(df.limit(0), r.record_order(df, "v"), "record_id").count() == 0


def test_weighted_pairs(spark):
    df = spark.createDataFrame([(1, "b", "abcdef"), (2, "b", "abcdxx"), (3, "b", None), (4, None, "abcdef"), (5, "c", "abcdef"), (6, "b", "a" * 3000)], "record_id long, block string, name string")
    pairs = k.weighted_pairs(df, ["block"], [("name", "edit", 1.0)], 0.4)
    assert [(x.src, x.dst) for x in pairs.collect()] == [(1, 2)]
    assert groups(k.link_weighted(df, ["block"], [("name", "edit", 1.0)], 0.4)) == {1: {1, 2}, 3: {3}, 4: {4}, 5: {5}, 6: {6}}


def test_small_ones(spark):
    df = spark.createDataFrame([(1, "B"), (1, "B"), (2, None), (None, "a")], "record_id long, value string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "record_id long")
    assert r.exclude(df, ids, "record_id").count() == 2 and r.shared_records(df, df).count() == 3 and r.union_links(df, df).count() == 8
    assert [(x.value, x["count"]) for x in a.top_values(df, "value").collect()][0] == ("B", 2)
    assert tuple(a.largest_id(df, "record_id").first()) == (2, 4) and tuple(a.largest_id(df.limit(0), "record_id").first()) == (None, 0)
    row = spark.createDataFrame([("é", "zz")], "a string, b string").select(fx.to_hex(F.col("a")), fx.from_hex(F.col("b")), fx.content_hash(F.lit(""))).first()
    assert row[0] == "c3a9" and row[1] is None and len(row[2]) == 40
