import random
import re

import numpy as np
import pytest
import xxhash

from tracelink.llm import simhash


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    """Smallest index reachable, by brute force."""
    own, todo = list(range(len(fps))), True
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    own = np.arange(len(fps))
    while todo:
        new = np.where(near, own[None, :], len(fps)).min(axis=1)
        todo, own = bool((new != own).any()), new
    return own


def test_fingerprint():
    for t in ["", None, "  \t", "One", "one two THREE", "É É é a b c", "a b c d e a b c d", "x y " * 50, "a\x85b c\x1cd e f"]:
        assert simhash.fingerprint((t or "").encode()) == plain(t)


@pytest.mark.parametrize(("count", "hot"), [(3, 20_000), (2, 20_000), (4, 20_000), (5, 3), (3, 40)])
def test_links_against_brute_force(spark, count, hot):
    rng = random.Random(count)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
                x ^= 1 << b
            fps.append(x)
    base = rng.getrandbits(64)  # one dense group
    fps += [base ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(150)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.connected_components(simhash.links(df, 4, count, hot)).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want = components(fps)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(place[r.node])
    expected = {}
    for i, c in enumerate(want):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_rows(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (7, None), (5, ""), (5, ""), (None, "lonely words stand here now"), (9, "other text that is not alike")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("3", 1), ("1", 1), ("7", 5), ("5", 5), ("5", 5), ("None", None), ("9", 9)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = np.array([plain(r.text) for r in docs], np.uint64)
    want = components(fps)
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, sf).collect()}
    for i, r in enumerate(docs):
        assert got[r.doc_id].fingerprint == f"{fps[i]:016x}"
        assert got[r.doc_id].component_id == docs[want[i]].doc_id


def test_hot_neighbours(spark):
    """A bucket with two entries next to buckets with very many: all their look-ups land in it, and are split."""
    rng = random.Random(8)
    low = 0x155555
    fps = {(rng.getrandbits(43) << 21) | low ^ (1 << b) for b in range(21) for _ in range(40)}
    own = [(x & ~((1 << 21) - 1)) | low for x in list(fps)[:2]]
    far = [x ^ (0b1111 << 30) for x in own]
    every = np.unique(np.array([*fps, *own, *far], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    for hot in (30, 20_000):
        groups = {}
        for r in simhash.connected_components(simhash.links(df, 4, 3, hot)).collect():
            groups.setdefault(r.component, set()).add(r.node)
        want = {}
        for x, c in zip(every.view(np.int64).tolist(), components(every), strict=True):
            want.setdefault(int(c), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
