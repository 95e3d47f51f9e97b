"""Keywords by automaton against counting one by one."""

import random
import re

import pytest

from tracelink.operators import keywords as kw


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_many_keywords_equal_single_counts(spark, most):
    rng = random.Random(6)
    letters = "aabbcdé "
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(400)} | {"aa", "aba", "日本", "x y"}
    rules = ["a+b", "[cd]{2}", "(?:ab|ba)c", "é."]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))) for i in range(60)] + [(100, None), (101, "a"), (102, "aaaaa"), (102, "aaaaa"), (None, "aba aba"), (103, "日本日本x y"), (104, "aab" * 20_000)]
    df = spark.createDataFrame([(*t, "k", "c") for t in texts], "doc_id long, text string, keyword string, class string")
    lexicon = [(w, "word") for w in words] + [("aa", "word"), ("aa", "twice"), (None, "none"), ("", "empty"), ("b", None)] + [(r, "rule") for r in rules]
    got = kw.tag_keywords(df, "doc_id", "text", spark.createDataFrame(lexicon, "keyword string, class string"), most)
    assert got.columns == ["doc_id", "keyword", "class", "count"]
    want = []
    for i, t in texts:
        for k, c in set(lexicon):
            if t is not None and len(t) >= 2 and k:
                n = len(re.findall(k if c == "rule" else re.escape(k), t))
                want += [(i, k, c, n)] * (n > 0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("text", "x")], "keyword string, class string")
    assert [tuple(r) for r in kw.tag_keywords(df, "doc_id", "text", lexicon).collect()] == [(1, "text", "x", 1)]
    assert kw.tag_keywords(df.limit(0), "doc_id", "text", lexicon).count() == 0 == kw.tag_keywords(df, "doc_id", "text", lexicon.limit(0)).count()
