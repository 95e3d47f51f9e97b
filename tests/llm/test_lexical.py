import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracelink.llm import lexical
from tracelink.llm.common import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, c in held if c)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        found = []
        for i, c in held:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & set(c):
                m = 100 - 50 + 50 * n * total // length
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(q, n + 1, i, -s) for n, (s, *_, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def sample(seed, count):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(60)] + ["Äpfel", "ŁÓDŹ", "日本", "x9", "don't", "A.B", "é"]
    p = 1 / np.arange(1, len(names) + 1)
    return [" ".join(rng.choice(names, rng.integers(0, 40), p=p / p.sum())) for _ in range(count)]


@pytest.mark.parametrize("k, most", [(5, 200_000), (3, 60)])
def test_against_brute_force(spark, monkeypatch, k, most):
    monkeypatch.setattr(lexical, "SHARD", 400)
    docs = list(enumerate(sample(0, 260))) + [(900, None), (901, ""), (902, " ,;. "), (None, "w1 w2 w3"), (5, "w1 w2"), (903, "w50 " * 3000), (903, "w50 " * 3000)]
    docs += [(1000 + i, "w7 w8 same text") for i in range(80)]  # ties beyond k
    queries = list(enumerate(sample(7, 12))) + [(70, "w7 w7 SAME"), (71, None), (72, "nowhere"), (73, ""), (74, "w50"), (None, "w1"), (3, "w3 w9")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int").repartition(3)
    got = lexical.search(df, spark.createDataFrame([(i, t, "y") for i, t in queries], "item_id long, text string, query string"), k, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, queries, k)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), queries).count() == 0
    assert lexical.search(docs.where("text = 'none'"), queries).count() == 0
    assert lexical.search(docs, queries.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", docs.text.substr(1, 0)), queries).count() == 0


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    size, lists, exact = 5000, [], np.zeros(5000, np.int64)
    for t in range(6):
        doc = np.argsort(np.arange(size) + rng.normal(scale=20, size=size))[:3000]  # good documents are good in every list
        value = np.sort((1e6 / (1 + np.arange(3000)) * (t + 1)).astype(np.int64))[::-1] + 1
        exact[doc] += value
        lists.append((doc, value))
    at, scores, read = lexical.nra(lists, size, 10)
    assert (exact[at] == scores).all()
    top = sorted((-exact).tolist())[:10]
    assert sorted((-scores).tolist())[:10] == top and read < 0.5 * sum(len(d) for d, _ in lists)
    floor = int(-top[4])
    at, scores, _ = lexical.nra(lists, size, 10, floor)
    assert sorted((-scores).tolist()) == [s for s in sorted((-exact).tolist()) if -s >= floor]


def test_words():
    texts = ["A b", "", " x ", "é\tZZ", "q", "r", "--", "end"]
    apart = np.isin(np.arange(256), [0x20, *range(9, 14)])
    found, starts = words(pa.array(["skipped", *texts], pa.large_string())[1:], apart)
    assert [w.decode() for w in found.to_pylist()] == ["a", "b", "x", "é", "zz", "q", "r", "--", "end"]
    assert starts.tolist() == [0, 2, 2, 3, 5, 6, 7, 8, 9]
    assert words(pa.array([], pa.large_string()), apart)[1].tolist() == [0]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, lexical.op13_lexical(spark, sf).collect()))
    assert len(got) > 100 and got == sorted(con.execute(lexical.OP13_SQL).fetchall())
