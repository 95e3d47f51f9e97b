import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelink.llm import topk


def brute(rows, k, is_query):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out |= {(q, n + 1, i, -s0) for n, (s0, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("rows_per_tree", [60, 20_000])
def test_against_brute_force(spark, rows_per_tree):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.2, size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # equal vectors
    rows += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [float("inf")] + [0.0] * 7), (2040, [0.0] * 8), (2050, [1.0] * 3), (2060, []), (None, [1.0] * 8), (7, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, tree_rows=rows_per_tree, block=40).collect()
    want = brute(rows, 5, lambda i: i % 10 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 2, 256 * 256 * 3), (0, 2, 1, 256 * 256 * 2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df.limit(1), F.col("vec_id") == 0).count() == 0


def test_bounds_skip_work():
    """Stored distances leave most scores uncomputed on clustered data, and few queries see the whole tree."""
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=200, size=(40, 16))
    x = np.rint(np.repeat(centres, 50, axis=0) + rng.normal(scale=5, size=(2000, 16))).astype(np.int64)
    tree = topk.MTree(np.arange(2000), x, int((x**2).sum(axis=1).max()))
    own = np.arange(0, 2000, 100)
    at, ids, scores = tree.search(own, x[own], 5)
    for row, q in enumerate(own):
        s = x @ x[q]
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if i != q)[:5]
        assert [(-v, i) for v, i in zip(scores[at == row].tolist(), ids[at == row].tolist(), strict=True)] == want
    assert tree.computed < 0.4 * len(own) * len(x)


def test_floor_and_large_integers():
    rng = np.random.default_rng(5)
    for size in (50, 1 << 27):  # the second has norms beyond what doubles hold exactly
        x = rng.integers(-size, size, (700, 8))
        largest = int(max(sum(int(v) ** 2 for v in row) for row in x)) + 1
        tree = topk.MTree(np.arange(700), x, largest)
        exact = [[sum(int(a) * int(b) for a, b in zip(x[q], y, strict=True)) for y in x] for q in range(20)]
        at, ids, scores = tree.search(np.arange(20), x[:20], 4)
        for q in range(20):
            want = sorted((-v, i) for i, v in enumerate(exact[q]) if i != q)[:4]
            assert [(-int(s), int(i)) for s, i in zip(scores[at == q], ids[at == q], strict=True)] == want
        high = np.array([float(sorted(e)[-3]) for e in exact])
        at, ids, scores = tree.search(np.arange(20), x[:20], 4, high)
        assert all(s >= high[q] for q, s in zip(at, scores, strict=True))


def test_scores_beyond_long(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(df, F.col("vec_id") == 0)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op5_mtree(spark, sf).collect())) == sorted(con.execute(topk.OP5_SQL).fetchall())
