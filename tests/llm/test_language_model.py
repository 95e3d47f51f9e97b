import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelink.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def bucket(n, k):
    return min(1, n) if k == 1 and n else n.bit_length()


class Brute:
    """The model by dictionaries and loops."""

    def __init__(self, texts, train, fold, order, rounds, settled):
        self.order = order
        both = [[Counter() for _ in range(order)] for _ in range(2)]
        for text, t, f in zip(texts, train, fold, strict=True):
            for own, use in zip(both, (t, f and t), strict=True):
                if use:
                    for k in range(1, order + 1):
                        own[k - 1].update(self.grams(text, k))
        self.count, held = both
        self.n, self.docs = sum(self.count[0].values()), sum(train)
        self.v = len(self.count[0])
        w = {}
        stats = [self.parts(text, i, [a - b for a, b in zip(self.count, held, strict=True)], self.n - sum(held[0].values()), self.docs - sum(f and t for f, t in zip(fold, train, strict=True))) for text, t, f in zip(texts, train, fold, strict=True) if t and f for i in range(len(tokens(text)))]
        weight = lambda k, b: 0.0 if b == 0 else w.get((k, b), 0.5)
        for _ in range(rounds):
            gave, reached = Counter(), Counter()
            for part in stats:
                left, q = 1.0, {}
                for k in range(order, 0, -1):
                    f, b = part[k - 1]
                    q[k] = left * weight(k, b) * f
                    left *= 1 - weight(k, b)
                q[0] = left / (self.v + 1)
                whole, below = sum(q.values()), q[0]
                for k in range(1, order + 1):
                    below += q[k]
                    gave[k, part[k - 1][1]] += q[k] / whole
                    reached[k, part[k - 1][1]] += below / whole
            new = {x: (gave[x] + 0.5) / (reached[x] + 1) for x in reached if x[1]}
            moved = max([0.0, *(abs(new[x] - weight(*x)) for x in new)])
            w = new
            if moved < settled:
                break
        self.w = {x: round(v, 6) for x, v in w.items()}

    def grams(self, text, k):
        t = [None] * (k - 1) + tokens(text)
        return [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]

    def parts(self, text, i, count, n, docs):
        out = []
        for k in range(1, self.order + 1):
            gram = self.grams(text, k)[i]
            context = n if k == 1 else docs if gram[-2] is None else count[k - 2][gram[:-1]]
            out.append((count[k - 1][gram] / context if context else 0.0, bucket(context, k)))
        return out

    def score(self, text):
        total = 0.0
        for i in range(len(tokens(text))):
            p = 1 / (self.v + 1)
            for k, (f, b) in enumerate(self.parts(text, i, self.count, self.n, self.docs), 1):
                w = 0.0 if b == 0 else self.w.get((k, b), 0.5)
                p = w * f + (1 - w) * p
            total += math.log10(p)
        return total


def sample(seed, count):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(40)] + ["Äpfel", "ŁÓDŹ", "A", "a", "don't,", " x"]
    p = 1 / np.arange(1, len(names) + 1)
    return [" \t".join(rng.choice(names, rng.integers(0, 30), p=p / p.sum())) for _ in range(count)]


@pytest.mark.parametrize("order, size", [(3, 1500), (2, 1 << 20), (1, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, order, size):
    monkeypatch.setattr(lm, "CHUNK", size)
    monkeypatch.setattr(lm, "BUCKET", 300)
    texts = [*sample(1, 150), None, "", " \n ", "new words only here", "w1 w2 w3 w4", "w1 w2 w3 w4", "w9 " * 2000]
    rows = [(i if i != 7 else None, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (0, texts[0], "y", 0)], "doc_id long, text string, train string, n int").repartition(3)
    texts.append(texts[0])
    n = [*range(len(rows)), 0]
    train, fold = [i % 5 != 2 for i in n], [i % 5 == 1 for i in n]
    want = Brute(texts, train, fold, order, 8, 1e-3)
    got = lm.score(df, F.col("n") % 5 != 2, F.col("n") % 5 == 1, order, 8).collect()
    assert len(got) == len(texts)
    key = lambda r: (r[0] is None, r[0], *map(str, r))
    expected = []
    for i, text, t in zip(n, texts, train, strict=True):
        own = tokens(text)
        expected.append((None if i == 7 else i, not t, len(own), sum(want.count[0][(w,)] > 0 for w in own), sum(math.log10((want.count[0][(w,)] + 1) / (want.n + want.v + 1)) for w in own), want.score(text), want.n))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[6] == b[6]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=2e-5)
    if order == 3:  # all words and one unknown share the whole
        known = [w for w, in want.count[0]]
        for context in ("w1", "w1 w2", "nothing", ""):

            def prob(w, context=context):
                p = 1 / (want.v + 1)
                t = [None, None, *tokens(context)[:-1], w]
                for k in range(1, 4):
                    gram = tuple(t[len(t) - k :])
                    c = want.n if k == 1 else want.docs if gram[-2] is None else want.count[k - 2][gram[:-1]]
                    b = bucket(c, k)
                    weight = 0.0 if b == 0 else want.w.get((k, b), 0.5)
                    p = weight * (want.count[k - 1][gram] / c if c else 0) + (1 - weight) * p
                return p

            assert sum(map(prob, known)) + prob("never seen") == pytest.approx(1)


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, lm.score(df, F.lit(False), F.lit(False)).collect()))
    assert got == [(1, True, 3, 0, 0.0, 0.0, 0), (2, True, 1, 0, 0.0, 0.0, 0)]
    assert lm.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_packed_numbers():
    for a in ([], [0], [255, 0], [256], [70_000, 1], [2**40], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(a, np.int64))).tolist() == a
    assert lm.unpack(lm.pack(np.array([2**64 - 1, 5], np.uint64))).tolist() == [2**64 - 1, 5]


def test_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    crc = [zlib.crc32(str(r.doc_id).encode()) for r in docs]
    train = [c % 7 != 2 for c in crc]
    count = Counter(w for r, t in zip(docs, train, strict=True) if t for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.op11_interpolation(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, t in zip(docs, train, strict=True):
        own, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (not t, len(own), sum(count[w] > 0 for w in own), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
