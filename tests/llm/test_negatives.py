import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelink.llm import negatives


def brute(rows, is_anchor, positives=5, count=5, low=80, high=100):
    ok = [(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in {r for r in ok if is_anchor(r[0])}:
        s = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, l) for i, l, v in ok if i != a]
        for ps, p, _ in sorted(x for x in s if x[2] == la)[:positives]:
            fits = sorted(x for x in s if x[2] != la and low * -ps <= 100 * -x[0] <= high * -ps)[:count]
            out += [(a, p, n + 1, i, -ps, -ns) for n, (ns, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("rows_per_block, anchors", [(110, 16), (4096, 1024)])
def test_against_brute_force(spark, rows_per_block, anchors):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.4, size=6)).tolist(), int(rng.integers(4))) for i in range(300)]
    rows += [(400 + i, [0.5] * 6, i % 3) for i in range(120)]  # ties of positives and negatives
    rows += [(600, None, 1), (610, [None] * 6, 1), (620, [1.0] * 6, None), (630, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (640, [], 2), (650, [1.0, 2.0], 9), (10, [0.3] * 6, 2)]
    rows += [rows[20], rows[20], rows[7]]  # repeated rows
    df = spark.createDataFrame([(i, v, l, 0.0, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, score double, key string")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, rows=rows_per_block, anchors=anchors).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)
    other = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, 2, 9, 50, 95, rows=rows_per_block, anchors=anchors).collect()))
    assert other == brute(rows, lambda i: i % 10 == 0, 2, 9, 50, 95)


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.1], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in negatives.mine(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") == 99).count() == 0
    assert negatives.mine(df, F.col("vec_id") == 2, high=90).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(df, F.col("vec_id") == 0, high=110)


def test_keys_sort_as_wanted():
    values = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    rows = sorted((a, -s, k, i) for a in values for s in values[1:] for k in (0, 1) for i in values)
    a, s, k, i = (np.array(x) for x in zip(*rows, strict=True))
    keys = [negatives.pack(a[n : n + 1], np.array([4]), -s[n : n + 1], int(k[n]), i[n : n + 1])[0].as_py() for n in range(len(rows))]
    assert keys == sorted(keys)
    assert [(x[0], -x[2], x[3], x[4]) for x in negatives.unpack(negatives.pack(a, np.full(len(a), 4), -s, 0, i))] == [(p, q, 0, r) for p, q, _, r in rows]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, negatives.op12_negatives(spark, sf).collect()))
    assert got and got == sorted(con.execute(negatives.OP12_SQL).fetchall())
