"""What queries shuffle and compare grows with their rows, and results stay those of the plain rule."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tracelink import session
from tracelink.operators import graph as g
from tracelink.operators import joins as j
from tracelink.operators import linkage as k
from tracelink.operators import maintained as m
from tracelink.plans import linking, storing
from tracelink.sources import tables as t
from tracelink.streaming import volume as stream


def shuffled(spark, run):
    """Records that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext

    def now():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = now()
    run()
    return sum(n for k, n in now().items() if k not in before)


def test_criteria_shuffle_lists_not_pairs(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(c * 100 + v, c, f"p{v}", f"q{v % 50}" if c % 3 else None) for v in range(100) for c in rng.sample(range(400), 25)]
    members = spark.createDataFrame([(c, r) for r, c, *_ in rows], "cluster_id long, record_id long")
    records = spark.createDataFrame([(r, p, q) for r, _, p, q in rows], "record_id long, p string, q string")
    held = {}
    for _, c, *values in rows:
        for a, v in enumerate(values):
            if v is not None:
                held.setdefault((a, v), {}).setdefault(c, 0)
                held[a, v][c] += 1
    shared = {}
    for (a, _), own in held.items():
        for c, n in own.items():
            for o, m in own.items():
                if o < c:
                    shared.setdefault((c, o), {}).setdefault(a, 0)
                    shared[c, o][a] += min(n, m)
    want = {(*k, "one", 0.25, s[0]) for k, s in shared.items() if 0 in s} | {(*k, "both", 0.75, s[0] + s[1]) for k, s in shared.items() if len(s) == 2}
    got = []
    criteria = [("one", 1, ["p"]), ("both", 3, ["p", "q"])]
    moved = shuffled(spark, lambda: got.extend(map(tuple, j.link_by_criteria(members, records, criteria, 60).collect())))
    assert set(got) == want and len(got) == len(want)
    assert moved < 25_000  # before: a row for each pair
    monkeypatch.setattr(j, "LIST", 3)
    assert set(map(tuple, j.link_by_criteria(members, records, criteria, None).collect())) == want


def test_weighted_links_compare_classes(spark, monkeypatch):
    rng = random.Random(5)
    names = ["red bolt", "red bolts", "blue ring", "blue rung", None]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(names), rng.choice("st"), (rng.choice([1.0, 60.0, None]), float(rng.randrange(0, 90, 10)))) for i in range(150)] + [(7, "x", "green", "s", (0.0, 0.0))]
    df = spark.createDataFrame([*rows, rows[0]], "record_id long, block string, name string, kind string, at struct<lat: double, lon: double>")
    features = [("name", "edit", 2.0), ("kind", "exact", 1.0), ("at", "geo", 1.0)]
    seen, plain = [], k.weighted_pairs
    monkeypatch.setattr(k, "weighted_pairs", lambda d, *a: (seen.append(d.count()), plain(d, *a))[1])
    for threshold in (0.1, 0.3, 0.35, 0.6):
        pairs = plain(df, ["block"], features, threshold)
        found = g.connected_components(pairs)
        want = {r.record_id: r.record_id for r in df.collect()} | {r.node: r.component for r in found.collect()}
        got = k.link_weighted(df, ["block"], features, threshold).collect()
        assert {r.record_id: r.cluster_id for r in got} == want and len(got) == len(want)
    assert min(seen) <= 2 * 2 * 5 + 150 - sum(r[1] is not None and r[2] is not None for r in rows) + 1  # classes, and rows with an unknown value
    assert k.link_weighted(df.limit(0), ["block"], features).count() == 0


def test_few_chunks_are_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "a", str(rng.randrange(25))) for i in range(60) for _ in range(2)]
    own = spark.createDataFrame(rows, "record_id long, attribute string, value string")
    want = sorted(map(tuple, k.link_best_match(own).collect()))
    steps, cut = [], k._by_steps
    monkeypatch.setattr(k, "_by_steps", lambda *a: (steps.append(1), cut(*a))[1])
    assert sorted(map(tuple, k.link_best_match(own, chunk_rows=40).collect())) == want and not steps
    assert sorted(map(tuple, k.link_best_match(own, chunk_rows=9).collect())) == want and steps


def _values(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(n, "a", f"v{v}") for v in range(100) for n in rng.sample(range(800), 40)], "node long, attribute string, value string")


def test_votes_shuffle_lists_not_pairs(spark):
    values = _values(spark)
    assert shuffled(spark, lambda: g.communities_by_values(values, 1).collect()) < 50_000  # before: a row for each pair


def test_links_shuffle_lists_not_pairs(spark):
    values = _values(spark)
    members, own = values.select(F.col("node").alias("cluster_id"), F.col("node").alias("record_id")).distinct(), values.withColumnRenamed("node", "record_id")
    assert shuffled(spark, lambda: m.links_of(members, own).collect()) < 50_000  # before: a row for each pair


def test_fingerprints_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, [rng.randrange(-40, 40) for _ in range(6 if i % 3 else 5)]) for i in rng.sample(range(900), 300)]
    rows += [(900, [2**31 - 1] * 6), (901, [-(2**31)] * 6), (902, [2**31 - 9] * 6), (903, [1, None, 3, 4, 5, 6]), (904, []), (905, None), (906, [2**31 - 1, -(2**31), 0, 0, 0, 0]), (907, [-(2**31), 2**31 - 1, 0, 0, 0, 0])]
    bins, want = [], {}
    for i, h in sorted(rows, key=lambda r: r[0]):
        if h is None:
            continue
        near = [b for b, o in bins if o == h or (len(o) == len(h) and None not in o + h and sum(abs(x - y) for x, y in zip(o, h, strict=True)) < 70)]
        want[i] = near[0] if near else i
        bins += [] if near else [(i, h)]
    monkeypatch.setattr(k, "BLOCK_ROWS", 16, raising=False)
    monkeypatch.setattr(k, "STEP", 50, raising=False)
    got = k.bin_fingerprints(spark.createDataFrame(rows, "item_id long, hash array<int>"), 70).collect()  # before: differences overflow
    assert {r.item_id: r.bin for r in got} == want and len(got) == len(want)
    assert len(set(want.values())) < len(want) - 50


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    values = _values(spark)  # 4,000 rows
    members = values.select(F.col("node").alias("cluster_id"), F.col("node").alias("record_id")).distinct()
    own = values.withColumnRenamed("node", "record_id")
    assert g.cluster_values(members, own).rdd.getNumPartitions() >= 40  # before: the session's partitions, whatever the rows
    once = j.attribute_links(own, directed=False)
    assert once.rdd.getNumPartitions() >= 80
    want = {}
    for r in own.groupBy("record_id").agg(F.sort_array(F.collect_list("value")).alias("vs")).collect():
        for i, x in enumerate(r.vs):
            for y in r.vs[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    assert {(r.val1, r.val2): r["count"] for r in once.collect()} == want


def test_forests_hold_a_bounded_part(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(2_000), rng.randrange(2_000)) for _ in range(3_000)], "u long, v long").coalesce(1)
    plain = {r.node: r.component for r in g.connected_components(edges, "u", "v").collect()}
    parts = g.local_forests(edges, most=100)
    assert {r.node: r.component for r in g.connected_components(parts, "u", "v").collect()} == plain


def test_kmeans_compiles_and_groups_once(spark):
    rng = random.Random(9)
    points = [(rng.choice([0, 10, 40]) + rng.random(), rng.choice([0, 30]) + rng.random(), rng.randrange(1, 4)) for _ in range(300)]
    df = spark.createDataFrame([*points, (None, 1.0, 2), (1.0, None, 2)], "lat double, lon double, count long")
    runs = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    got = g.geo_kmeans(df.mapInArrow(tell, df.schema), 9, 50).collect()
    assert runs.value == 302  # before: all points again in each round
    assert sum(r["count"] for r in got) == sum(p[2] for p in points)
    for r in got:  # a centre is the mean of the points that are nearest to it
        own = [p for p in points if min(got, key=lambda c: (c.lat - p[0]) ** 2 + (c.lon - p[1]) ** 2) == r]
        assert abs(sum(p[0] * p[2] for p in own) / sum(p[2] for p in own) - r.lat) < 1e-6


def test_pictures_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "SHEET_BYTES", 5_000)
    rng = random.Random(4)
    texts = {f"key {i}" + "x" * (60 * (i % 7 == 0)): rng.randbytes(rng.randrange(1, 400)) for i in range(200)} | {"large": rng.randbytes(20_000)}
    rows = [*texts.items(), ("key 1", texts["key 1"]), (None, b"a"), ("none", None), ("empty", b"")]
    df = spark.createDataFrame(rows, "key string, data binary").repartition(3)
    assert t.render_sheets(df, "key", "data", f"file://{tmp_path}/sheets") == len(texts) + 1
    assert len([n for n in os.listdir(tmp_path / "sheets") if n.endswith(".bmp")]) <= 30  # before: a file for each row
    want = {}
    for key, data in texts.items():
        data += bytes(-len(data) % 48)
        bins = [data[i] // 64 * 16 + data[i + 1] // 64 * 4 + data[i + 2] // 64 for i in range(0, len(data), 3)]
        want[key] = bytes(min(255, bins.count(b) * 64 // len(bins)) for b in range(64)).hex()
    got = k.sheet_histogram(spark, f"file://{tmp_path}/sheets").collect()
    assert {r.key: r.hash for r in got} == want and len(got) == len(want)


def _told_rows(df, runs):
    """``df`` that adds each row to an accumulator as often as it is read."""

    def tell(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    return df.mapInArrow(tell, df.schema)


def test_groups_read_rows_once(spark):
    rng = random.Random(6)
    rows = [(i % 90, rng.choice(["A", "b", "c", None]), rng.choice(["x", "y", "z", None])) for i in range(200)]
    runs = spark.sparkContext.accumulator(0)
    k.link_primary_secondary(_told_rows(spark.createDataFrame(rows, "record_id long, p string, s string"), runs), "p", "s").collect()
    assert runs.value == 200  # before: twice for the groups and twice for their rows


def test_seed_rounds_shuffle_numbers(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(r, "a", f"{rng.randrange(300):0200}") for r in range(3_000) for _ in range(3)]
    seen, plain = [], k.first_seeds
    monkeypatch.setattr(k, "first_seeds", lambda df, *a: (seen.append(dict(df.dtypes)), plain(df, *a))[1])
    held, want = {}, {}
    for r in range(3_000):
        own = sorted({x[2] for x in rows[3 * r : 3 * r + 3]})
        want[r] = next((held[v] for v in own if v in held), r)
        if want[r] == r:
            held |= dict.fromkeys(own, r)
    got = k.link_by_seed(spark.createDataFrame(rows, "record_id long, attribute string, value string").repartition(5), ["a"], chunk_rows=200).collect()
    assert {r.record_id: r.cluster_id for r in got} == want and len(got) == len(want)
    assert seen == [{"record_id": "bigint", "value": "bigint"}]  # before: attributes and values as texts in every round


def test_rings_compute_values_once(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(150), "a", str(rng.randrange(120))) for _ in range(300)]
    own = {}
    for n, _, v in rows:
        own.setdefault(v, set()).add(n)
    want, new = {1: 0, 2: 0}, {1, 2}
    for ring in (1, 2, 3):
        new = {n for held in own.values() if held & new for n in held} - set(want)
        want |= dict.fromkeys(new, ring)
    runs = spark.sparkContext.accumulator(0)
    values = _told_rows(spark.createDataFrame(rows, "cluster_id long, attribute string, value string"), runs)
    got = g.expand_rings_by_values(spark.createDataFrame([(1,), (2,)], "node long"), values, 4).collect()
    assert {r.node: r.ring for r in got} == want and len(got) == len(want)
    assert runs.value == 300  # before: twice in each ring


def test_stream_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    rows = [(i, f"2024-01-{1 + i // 40:02} 10:{rng.randrange(60):02}:00", i % 17, rng.choice("abc")) for i in range(1_000)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(6).write.option("maxRecordsPerFile", 200).parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(storing, "work_path", lambda _, name: f"{tmp_path}/{name}")
    seen, want = set(), {}
    for i, _, user, town in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = "new to data" if user not in seen else "new to town" if (user, town) not in seen else "local"
        seen |= {user, (user, town)}
    got = storing.QUERIES["j3_stream_labels"](spark, str(tmp_path)).collect()
    assert {r.event_id: r.label for r in got} == want and len(got) == len(want)
    assert len([n for n in os.listdir(tmp_path / "events") if n.endswith(".parquet")]) > 3  # before: a part is one task's file


def test_rules_shuffle_values_once(spark):
    rng = random.Random(4)
    people = [(i, rng.choice(["A", "b", "", None]), rng.randrange(4_000)) for i in range(3_000)]
    rows = [(i, rng.randrange(3_000) or None, s, c if c % 5 else None) for i, s, c in people for _ in range(4)]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, "A", 1)], "record_id long, part long, source string, customer long").repartition(4).localCheckpoint()
    skip = spark.createDataFrame([(f"{p}|{s}",) for p in range(0, 3_000, 3) for s in "AB"] + [(None,), ("0|A",)], "value string")
    root = {r: r for r, *_ in rows}

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    held = {}
    for r, p, s, c in rows:
        keys = [(p, s.lower())] if p and s and p % 3 else []
        for key in keys + ([c] if c is not None else []):
            a, b = sorted((top(r), top(held.setdefault(key, r))))
            root[b] = a
    got = []
    rules = {"part": [F.col("part"), F.col("source")], "customer": [F.col("customer")]}
    moved = shuffled(spark, lambda: got.extend(k.link_by_rules(df, rules, {"part": skip}).collect()))
    assert {r.record_id: r.cluster_id for r in got} == {r: top(r) for r in root} and len(got) == len(root)
    assert sum(top(r) == r for r in root) > 50  # some are alone
    assert moved < 80_000, moved


def test_levels_hold_a_bounded_part(spark, monkeypatch):
    monkeypatch.setattr(g, "TASK_ROWS", 50)
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rng = random.Random(6)
    own = [(f"r{i:04}", f"v{rng.randrange(250)}") for i in range(900) for _ in range(2)] + [(f"r{i:04}", "hot") for i in range(300)] + [("r0000", f"w{i}") for i in range(300)]
    own += [(f"r{i:04}", f"p{i + n}") for i in range(2_000, 2_040) for n in (0, 1)] + [("r3000", "alone")]
    df = spark.createDataFrame(own, "u string, value string")
    least = {v: min(r for r, x in own if x == v) for _, v in own}
    links = spark.createDataFrame([(r, least[v]) for r, v in own], "u string, v string")
    plain = {r.node: r.component for r in g.connected_components(links, "u", "v").collect()}
    for most in (20, 1_000_000):
        got = g.components_by_levels(links, most).collect()
        assert {r.node: r.component for r in got} == plain and len(got) == len(plain)
    named = df.select(F.col("u").alias("record_id"), F.lit("a").alias("attribute"), "value")
    assert {r.record_id: r.component for r in k.record_components(named).collect()} == plain
    assert g.components_by_levels(links.limit(0)).count() == 0


def test_steps_hand_on_few_files(spark, monkeypatch):
    """One component in steps of several groups: a step tells a later one by one file, whatever number of tasks it ran in."""
    rng = random.Random(11)
    own = spark.createDataFrame([(i, "a", str(v)) for i in range(60) for v in {rng.randrange(60) for _ in range(2)}], "record_id long, attribute string, value string")
    want = sorted(map(tuple, k.link_best_match(own).collect()))
    made, plain = [], k.work_path
    monkeypatch.setattr(k, "work_path", lambda *a: (made.append(plain(*a)), made[-1])[1])
    assert sorted(map(tuple, k.link_best_match(own, chunk_rows=3).collect())) == want
    told = [os.listdir(at) for at, _, _ in os.walk(f"{made[-1].removeprefix('file://')}/told") if "to=" in at]
    files = [sum(f.endswith(".parquet") for f in names) for names in told]
    assert len(files) > 4 and set(files) == {1}  # before: one of each task


def test_best_match_of_arrays_is_the_plain_rule():
    rng, none = random.Random(8), np.empty(0, np.int64)
    for trial in range(40):
        many = rng.choice([2, 9, 60])
        records = {i: sorted({rng.randrange(many) for _ in range(rng.randrange(1, 5))}) for i in rng.sample(range(500), 70)}
        before = [(v, -rng.randrange(1, 9), rng.randrange(1, 4)) for v in range(many) if rng.random() < 0.4]
        held, want = {v: {c: n} for v, c, n in before}, []
        for r in sorted(records):
            scores = {}
            for v in records[r]:
                for c, n in held.get(v, {}).items():
                    scores[c] = scores.get(c, 0) + n
            want.append(min(scores, key=lambda c: (-scores[c], c)) if scores else r)
            for v in records[r]:
                held.setdefault(v, {})[want[-1]] = held.get(v, {}).get(want[-1], 0) + 1
        ids = np.array(sorted(records))
        sizes = [len(records[r]) for r in sorted(records)]
        state = tuple(np.array(x, np.int64) for x in zip(*before, strict=True)) if before else (none, none, none)
        rule = k.BestMatch(rng.choice([0, 1, 1000]), rng.choice([0, 2, 100]))  # all together, some one by one, or all
        got, (values, clusters, counts) = rule.run(ids, np.cumsum([0, *sizes[:-1]]), np.array([v for r in sorted(records) for v in records[r]]), state, None)
        assert got.tolist() == want, trial
        assert {(v, c): n for v, own in held.items() for c, n in own.items()} == dict(zip(zip(values.tolist(), clusters.tolist(), strict=True), counts.tolist(), strict=True))


def test_scores_compare_classes(spark, monkeypatch):
    rng = random.Random(5)
    names = ["red bolt", "red bolts", "blue ring", "blue rung", None]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(names), rng.choice("st"), (rng.choice([1.0, 60.0, None]), 10.0)) for i in range(150)] + [(7, "x", "red bolt", "s", (1.0, 10.0)), (None, "x", "red bolt", "s", None)]
    df = spark.createDataFrame([*rows, rows[0]], "record_id long, block string, name string, kind string, at struct<lat: double, lon: double>")
    members = spark.createDataFrame([(i % 3 if i % 11 else None, i) for i in range(140)], "cluster_id long, record_id long")
    features = [("name", "edit", 2.0), ("kind", "exact", 1.0), ("at", "geo", 1.0)]
    seen, plain = [], k.weighted_pairs
    monkeypatch.setattr(k, "weighted_pairs", lambda d, *a: (seen.append(d.count()), plain(d, *a))[1])
    for threshold, some in ((0.3, features), (0.6, features), (0.4, features[:1])):
        want = k.score_members(plain(df, ["block"], some, threshold), members)
        got = k.score_weighted(df, members, ["block"], some, threshold)
        for a, b in zip(want, got, strict=True):
            a, b = ({r[:-1]: r[-1] for r in map(tuple, x.collect())} for x in (a, b))
            assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 2e-6 for x in a)
    assert seen[-1] <= 3 * 3 * 5 and len({s for s in a.values()}) > 1  # before: a row of each record
    assert k.score_weighted(df.limit(0), members, ["block"], features)[0].where("score <> 1").count() == 0


def test_updates_and_streams_compute_identifiers_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "part", str(v)) for i in range(60) for v in {rng.randrange(30) for _ in range(2)}]
    own = spark.createDataFrame(rows, "record_id long, attribute string, value string")
    want = sorted(map(tuple, k.link_best_match(own).collect()))
    for plan, query in ((linking, linking.i1), (linking, linking.i2), (storing, storing.j2)):
        runs = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(plan, "idents", lambda *_, runs=runs: _told_rows(own, runs))
        got = sorted(map(tuple, query(spark, "").collect()))
        assert runs.value == len(rows)  # before: for each of its uses
        assert got == want or query is linking.i1


def test_a_stream_adds_up_what_its_batches_hold(spark, tmp_path):
    """Three batches: cluster 10 has x of two batches, together more than cluster 1 has y."""
    at, out, state, held = (f"{tmp_path}/{n}" for n in ("rows", "members", "state", "held"))
    schema = "record_id long, attribute string, value string"
    for rows in ([(1, "y"), (2, "y"), (10, "x"), (11, "x")], [(20, "x")], [(30, "x"), (30, "y")]):
        spark.createDataFrame([(r, "a", v) for r, v in rows], schema).coalesce(1).write.mode("append").parquet(at)
        stream.link_stream(stream.stream_table(spark, at, schema), out, held, state)
    assert {r.record_id: r.cluster_id for r in stream.read_members(spark, out).collect()} == {1: 1, 2: 1, 10: 10, 11: 10, 20: 10, 30: 10}  # before: 30 in 1
