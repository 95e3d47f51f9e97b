import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelink.llm import toxicity as tx


@lru_cache(maxsize=None)
def subsequences(x):
    """Weights of all subsequences without wide gaps, by enumeration."""
    out = defaultdict(float)
    for at in combinations(range(len(x)), tx.ORDER):
        steps = [b - a for a, b in zip(at, at[1:], strict=False)]
        if max(steps) <= tx.REACH and (x[at[0]] != tx.START[0] or steps[0] == 1):
            out[bytes(x[i] for i in at)] += tx.DECAY ** (sum(steps) - len(steps))
    return out


def plain_kernel(s, t):
    return sum(w * subsequences(t).get(u, 0.0) for u, w in subsequences(s).items())


def test_kernel():
    rng = np.random.default_rng(1)
    marks = [b"^idiot$", b"^moron$", b"^aaaaa$", b"^lowei", "^réeux".encode()]
    words = [b"^idiot$", b"^id*iot$", b"^patriots$", b"x", b"", b"^aaa$", b"^aaaaaaa$", "^éréeuxé$".encode()]
    words += [bytes(rng.choice(list(b"idotmrn*^$"), rng.integers(0, 16)).tolist()) for _ in range(60)]
    got = tx.Landmarks(marks).kernel(words)
    assert np.allclose(got, [[plain_kernel(w, m) for m in marks] for w in words], rtol=1e-4)


def test_landmarks_over_windows():
    marks = tx.Landmarks([b"^idiot$", b"^lowei"])
    words = [b"idiot", b"loweischaft", b"house", b"z" * 200 + b"lowei" + b"z" * 200, b"idi-ot", b"", b"so,idiot,there", b"x" * 60 + b"(idiot)"]
    hits, values = marks(words, 0.2)
    own = {int(h): v for h, v in zip(hits, values, strict=True)}
    assert own[0][0] == 1 and own[1][1] > 0.999 and own[4][0] > 0.5
    assert own[3][1] > 0.3 and own[6][0] == 1 and own[7][0] == 1  # deep in a long word, and set off by signs
    assert 2 not in own and 5 not in own


def test_train_and_score():
    rng = np.random.default_rng(3)
    clean = [" ".join("".join(rng.choice(list("abcdefghklmnoprstu"), rng.integers(2, 9))) for _ in range(60)) + "." for _ in range(380)]
    bad = [c[:150] + " " + ["moron", "clown"][i % 2] + " " + c[150:] for i, c in enumerate(clean[:100])]
    model = tx.train(clean[100:280] + bad[:60], np.array([0] * 180 + [1] * 60))  # the classes in the ratio that fit() takes
    s = model.scores(pa.array(clean[280:] + bad[60:] + ["", "you mo-ron!", "a m o r o n here", "a mororn, a mo**ron"], pa.large_string()))
    assert (s[:100] < 0.5).mean() > 0.95 and (s[100:140] >= 0.5).all()
    assert s[140] < 0.5 and (s[141:] >= 0.5).all()
    each = model.sentences("all is well. you moron. fine")
    assert len(each) == 3 and each[1] >= 0.5 > max(each[0], each[2])


def plain_score(model, text):
    """The score of a text, place by place."""
    best = model.weights[-1]
    marks = model.landmarks
    for word in re.split(r"[\s.]+", re.sub("[\u200b\u00ad]", "", text.lower())):
        word = word.strip(tx.PUNCTUATION).encode()
        parts = tx.INNER.split(word)
        pieces = {word, *(x for x in [*parts, b"".join(parts)] if len(x) >= tx.ORDER)}
        v = np.max([[min(1, plain_kernel(b"^" + w + b"$", m) / plain_kernel(m, m)) for m in marks.strings] for w in pieces], axis=0)
        if v[: marks.leading].max() >= 0.25:
            best = max(best, v @ marks.whiten @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + np.exp(-(model.slope * best + model.offset)))


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    syllables = ["mo", "ron", "clo", "wn", "sa", "te", "li", "do"]
    rows = [(i, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(12)) + (" idiot" if i % 4 == 0 else " id-iot, you" if i % 9 == 0 else " id\u200bi*ot so" if i % 11 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    assert model.landmarks is not None
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-4)


def test_repeated_ids_are_fetched_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert model.landmarks is None  # three texts at most


def test_degenerate_training():
    for y in ([], [0, 0], [1, 1], [0, 1]):
        model = tx.train(["some text"] * len(y), np.array(y, np.int64))
        s = model.scores(pa.array(["", "x", None], pa.large_string()).fill_null(""))
        assert ((s >= 0) & (s <= 1)).all()


def test_table(spark):
    rows = [(i, "you moron person" if i % 3 == 0 else f"calm words number {i} here", "x", 0.5) for i in range(90)] + [(None, None, "x", 0.1), (1, "", "x", 0.1), (1, "", "x", 0.1), (7, "word " * 20_000, "x", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = tx.op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    own = [(labels[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [x for x in own if x[0]], [x for x in own if not x[0]]
    assert sum(p for _, p, _ in toxic) / len(toxic) > 0.9
    assert sum(p for _, p, _ in clean) / len(clean) < 0.05
    a, b = np.array([s for *_, s in toxic]), np.array([s for *_, s in clean])
    # some toxic labels of this table belong to junk lines that hold nothing toxic; measured: 0.945
    assert (a[:, None] > b[None, :]).mean() > 0.93


def test_disguised_insults(spark):
    """Insults with characters inserted, doubled or set apart, in held-out clean English documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where((docs.lang == "en") & tx.held_out(docs.doc_id) & (F.length("text") < 4000)).collect()]
    words = "idiot moron scum loser worthless clown trash pathetic disgusting stupid".split()
    half = lambda w, sign: w[: len(w) // 2] + sign + w[len(w) // 2 :]
    apart = lambda w: w[0] + "*" + w[1:-1] + "-" + w[-1]
    kinds = {"two signs": lambda w: half(w, "*-"), "two places": apart, "no width": lambda w: "\u200b".join(w), "plain": str, "star": lambda w: half(w, "*"), "dash": lambda w: half(w, "-"), "letter": lambda w: half(w, "x"), "doubled": lambda w: w[:2] + w[1:], "dotted": ".".join, "spaced": " ".join}
    base = model.scores(pa.array(clean, pa.large_string()))
    assert len(clean) > 100 and (base >= 0.5).mean() < 0.05
    for kind, change in kinds.items():
        texts = [t[:100] + f" you are {change(words[i % 10])} today " + t[100:] for i, t in enumerate(clean)]
        assert (model.scores(pa.array(texts, pa.large_string())) >= 0.5).mean() >= 0.8, kind
    # everyday words near an insult, none of which the labelled texts have
    everyday = "morning sympathetic clone idiom apathetic disguised moral losing classic stupendous tropical worth crowned".split()
    scores = dict(zip(everyday, model.scores(pa.array([f"We saw the {w} again." for w in everyday], pa.large_string())), strict=True))
    assert all(v < 0.5 for v in scores.values()), scores
    assert model.scores(pa.array(["Good morning, everyone."], pa.large_string()))[0] < 0.5
