"""Hand-worked cases and properties of what SQL cannot express."""

import random

import pytest
from pyspark.sql import functions as F

from tracelink.operators import graph as g
from tracelink.operators import linkage as k
from tracelink.operators import updates as u

IDS = "record_id long, attribute string, value string"


def idents(spark, records, attribute="a"):
    return spark.createDataFrame([(r, attribute, v) for r, values in records.items() for v in values], IDS)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.record_id)
    return out


def test_best_match_cases(spark):
    assert groups(k.link_best_match(idents(spark, {1: "a", 2: "a", 3: "b", 4: "ab"}))) == {1: {1, 2, 4}, 3: {3}}
    assert groups(k.link_best_match(idents(spark, {1: "a", 2: "b", 3: "ab"}))) == {1: {1, 3}, 2: {2}}


def test_seed_case_and_components(spark):
    own = idents(spark, {1: ["a001"], 2: ["a001", "b001"], 3: ["b001"]})
    assert groups(k.link_by_seed(own, ["a"])) == {1: {1, 2}, 3: {3}}
    assert {r.component for r in k.record_components(own).collect()} == {1}
    assert groups(k.link_by_seed(own.withColumn("key", F.col("record_id") % 2), ["a"], key="key")) == {1: {1}, 2: {2}, 3: {3}}


def whole_run(records):
    """Best match over all records at once."""
    held, out = {}, {}
    for r in sorted(records):
        scores = {}
        for v in dict.fromkeys(records[r]):
            for c, n in held.get(v, {}).items():
                scores[c] = scores.get(c, 0) + n
        out[r] = c = min(scores, key=lambda c: (-scores[c], c)) if scores else r
        for v in dict.fromkeys(records[r]):
            held.setdefault(v, {})[c] = held.get(v, {}).get(c, 0) + 1
    return out


@pytest.fixture(scope="module")
def many():
    rng = random.Random(11)
    return {i: [str(rng.randrange(60)) for _ in range(rng.randrange(1, 4))] for i in range(1, 60)}


def test_components_give_the_whole_run(spark, many):
    own = idents(spark, many).distinct()
    want = whole_run(many)
    got = k.link_best_match(own.repartition(7)).collect()
    assert {r.record_id: r.cluster_id for r in got} == want and len(got) == len(want)
    for rows in (6, 25):  # in steps, far above what one task takes
        got = k.link_best_match(own, chunk_rows=rows).collect()
        assert {r.record_id: r.cluster_id for r in got} == want and len(got) == len(want)


def test_steps_read_state_once(spark, many):
    """One component in steps: groups of a step run side by side, and what is handed on grows with values in steps."""
    own = idents(spark, {r: dict.fromkeys(v) for r, v in many.items()})
    rows = own.select(F.lit(1).cast("long").alias("component"), "*").join(k.record_components(own).groupBy("component").count().orderBy(F.desc("count")).limit(1).join(k.record_components(own), "component").select("record_id"), "record_id")
    steps = k._in_steps(rows, 6).collect()
    assert len(steps) == rows.count() and len({r.step for r in steps}) > 3
    assert max(len({r.group for r in steps if r.step == n}) for n in {r.step for r in steps}) > 2
    for r in steps:
        later = [x for x in steps if x.value == r.value and x.step > r.step]
        assert (r.to, r.to_group) == (min((x.step, x.group) for x in later) if later else (None, None))
    order = {r.record_id: r.step for r in steps}
    assert [order[x] for x in sorted(order)] == sorted(order.values())


def test_seeds_in_chunks(spark, many):
    own = idents(spark, many).unionByName(idents(spark, {i: [f"0{v[0]}"] for i, v in many.items()}, "b")).unionByName(idents(spark, {5: [None]}))
    whole = groups(k.link_by_seed(own, ["b", "a"], 1))
    held, want = {}, {}
    for r in sorted(many):
        keys = sorted([(0, f"0{many[r][0]}")] + [(1, v) for v in set(many[r])])
        c = next((held[x] for x in keys if x in held), None)
        if c is None:
            c = r
            held |= dict.fromkeys(keys, r)
        want.setdefault(c, set()).add(r)
    assert whole == want and groups(k.link_by_seed(own, ["b", "a"], 1, chunk_rows=8)) == want


def by_seeds(rows, order, least):
    """The sequential rule over (record, attribute, value)."""
    held, out, records = {}, {}, {}
    for r, a, v in rows:
        if r is not None and v is not None:
            records.setdefault(r, set()).add((a, v))
    for r in sorted(records):
        own = sorted((order.index(a) if a in order else len(order), v, a) for a, v in records[r] if len(v) >= least)
        out[r] = next((held[x[1:]] for x in own if x[1:] in held), r)
        if out[r] == r:
            held |= {x[1:]: r for x in own}
    return out


@pytest.mark.parametrize("chunk, parts", [(1, 3), (40, 7), (100_000, 1)])
def test_seeds_in_rounds(spark, chunk, parts):
    """One giant component, a hot value, short values, chains in id order and repeated rows, at any partition number."""
    rng = random.Random(5)
    rows = [(r, rng.choice("abc"), str(rng.randrange(6, 40))) for r in range(1, 70) for _ in range(rng.randrange(1, 4))]
    rows += [(r, "c", "hot1") for r in range(30, 60)] + [(r, "a", f"{r:04}") for r in range(70, 90)] + [(r + 1, "a", f"{r:04}") for r in range(70, 90)]
    rows += [rows[0], (200, "a", "x"), (201, "b", None), (None, "a", "0071"), (202, "a", "x")]
    df = spark.createDataFrame([(*x, "other", 1) for x in rows], IDS + ", least string, seed int").repartition(parts)
    got = k.link_by_seed(df, ["b", "a"], 2, chunk_rows=chunk).collect()
    assert {r.record_id: r.cluster_id for r in got} == by_seeds(rows, ["b", "a"], 2) and len(got) == len({r.record_id for r in got})
    assert k.link_by_seed(df.limit(0), ["a"]).count() == 0
    flat = spark.createDataFrame([(r, f"p{r % 40}", v) for r, _, v in rows if r is not None], "record_id long, p string, s string")
    named = {p: min(r for r, _, _ in rows if r is not None and r % 40 == int(p[1:])) for p in {f"p{r % 40}" for r, _, _ in rows if r is not None}}
    joined = by_seeds([(named[f"p{r % 40}"], "s", v) for r, _, v in rows if r is not None], ["s"], 1)
    want = {r: joined.get(named[f"p{r % 40}"], named[f"p{r % 40}"]) for r, _, _ in rows if r is not None}
    assert {r.record_id: r.cluster_id for r in k.link_primary_secondary(flat, "p", "s", chunk).collect()} == want


def test_incremental_equals_whole_run(spark, many):
    old = idents(spark, {i: v for i, v in many.items() if i <= 40}).distinct()
    new = idents(spark, {i: v for i, v in many.items() if i > 40}).distinct()
    chunked = u.link_incremental(new, k.link_best_match(old), old, chunk_rows=4).collect()
    assert {r.record_id: r.cluster_id for r in chunked} == whole_run(many) and len(chunked) == len(many)
    got = u.link_incremental(new, k.link_best_match(old), old).collect()
    assert {r.record_id: r.cluster_id for r in got} == whole_run(many) and len(got) == len(many)


def test_invalidation_equals_recompute(spark, many):
    own = idents(spark, many).distinct()
    left, members = u.invalidate_value(own, k.link_best_match(own), "a", "7")
    want = {r: [v for v in vs if v != "7"] for r, vs in many.items()}
    assert {r.record_id: r.cluster_id for r in members.collect()} == whole_run({r: v for r, v in want.items() if v})
    assert left.where("value = '7'").isEmpty()


def test_primary_secondary(spark):
    df = spark.createDataFrame([(1, "p", "x"), (2, "p", None), (3, "q", "y"), (4, "r", "x"), (5, "s", None)], "record_id long, p string, s string")
    assert groups(k.link_primary_secondary(df, "p", "s")) == {1: {1, 2, 4}, 3: {3}, 5: {5}}


def test_connected_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    own = {n: n for e in edges for n in e}
    for _ in own:
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    df = spark.createDataFrame([*edges, (None, 3), (5, None), edges[0]], "src long, dst long")
    assert {r.node: r.component for r in g.connected_components(df).collect()} == own
    assert g.connected_components(df.limit(0)).count() == 0


def test_rings(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.ring for r in g.expand_rings(seed, links, 3).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.node: r.ring for r in g.expand_rings(seed, links, 1).collect()} == {1: 0}
    assert g.expand_rings(seed, links, 9, cap=2).count() == 2


def test_communities(spark):
    edges = [(a, b, 2) for c in ((1, 2, 3), (11, 12, 13)) for a in c for b in c if a < b] + [(3, 11, 1)]
    got = {r.node: r.community for r in g.communities(spark.createDataFrame(edges, "src long, dst long, weight long")).collect()}
    assert got[1] == got[2] == got[3] != got[11] == got[12] == got[13]


def test_communities_by_values(spark):
    """Equal to votes along all links, whose weight is the number of shared values."""
    rng = random.Random(9)
    rows = {(n, "ab"[rng.randrange(2)], str(rng.randrange(9))) for n in range(40) for _ in range(rng.randrange(1, 4))} | {(n, "a", "hot") for n in range(20)} | {(90, "a", "alone")}
    values = spark.createDataFrame([*rows, *list(rows)[:5], (None, "a", "hot"), (91, "a", None)], "node long, attribute string, value string")
    weights = {}
    for n, a, v in rows:
        for m, b, w in rows:
            if n < m and (a, v) == (b, w):
                weights[n, m] = weights.get((n, m), 0) + 1
    pairs = spark.createDataFrame([(*p, w) for p, w in weights.items()], "src long, dst long, weight long")
    for rounds in (1, 4):
        want = {tuple(r) for r in g.communities(pairs, rounds).collect()} | {(n, n, True) for n in {n for n, *_ in rows} - {x for p in weights for x in p}}
        got = g.communities_by_values(values, rounds).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert g.communities_by_values(values.limit(0)).count() == 0


def test_geo_kmeans(spark):
    points = spark.createDataFrame([(0.0, 0.0)] * 5 + [(10.0, 10.0)] * 3 + [(None, 1.0)], "lat double, lon double")
    assert sorted(map(tuple, g.geo_kmeans(points, 4).collect())) == [(0.0, 0.0, 5), (10.0, 10.0, 3)]
    assert g.geo_kmeans(points.limit(0), 4).count() == 0


def test_bins(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(0, 6) for _ in range(8)]) for i in range(80)]
    reps, want = [], {}
    for i, h in rows:
        for r, rh in reps:
            if h == rh or sum(abs(a - b) for a, b in zip(h, rh, strict=True)) < 10:
                want[i] = r
                break
        else:
            reps.append((i, h))
            want[i] = i
    got = k.bin_fingerprints(spark.createDataFrame([*rows, (900, None)], "item_id long, hash array<int>"), 10)
    assert {r.item_id: r.bin for r in got.collect()} == want


def test_image_histogram(spark, tmp_path):
    def png(path, rgb, size=8):
        import struct
        import zlib

        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(rgb) * size for _ in range(size))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "a.png", (255, 0, 0))
    png(tmp_path / "b.png", (255, 3, 9))
    png(tmp_path / "c.png", (0, 0, 255))
    rows = {r.origin.rsplit("/", 1)[1]: bytes.fromhex(r.hash) for r in k.image_histogram(spark, str(tmp_path)).collect()}
    assert rows["a.png"] == rows["b.png"] != rows["c.png"]
    assert rows["a.png"][3 * 16] == 64 and rows["c.png"][3] == 64
