import datetime

from pyspark.sql import functions as F

from tracelink.functions import text as fx
from tracelink.operators import aggregate as ag
from tracelink.operators import filters
from tracelink.operators import linkage as k
from tracelink.operators import ranking as r
from tracelink.sources import tables as s
from tracelink.streaming import volume as v

SF = "/root/testdata/sf0.001"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, fx.digits, "+1 (23)") == "123" and one(spark, fx.digits, "none") is None
    assert one(spark, fx.phone_key, "five FIVE 5-12 three 4") == "5551234" and one(spark, fx.phone_key, "12") == ""
    assert one(spark, fx.fingerprint_key, "Foo, bar") == one(spark, fx.fingerprint_key, "bar foo")
    assert one(spark, lambda c: fx.strip_html(c, ("b",)), "<p>a <b>c</b> &amp;lt;</p>") == "a <b>c</b> &lt;"
    assert one(spark, fx.url_subdomain, "http://city.example.com/x") == "city" and one(spark, fx.url_subdomain, "nothing") is None
    two = [datetime.datetime(2024, 1, 1, 3, 30), datetime.datetime(2024, 1, 1, 13, 30)]
    df = spark.createDataFrame([(t,) for t in two], "t timestamp")
    assert df.select(fx.day_bucket(F.col("t"), "half_day")).distinct().count() == 2 and df.select(fx.day_bucket(F.col("t"))).distinct().count() == 1


def test_clean_values(spark):
    df = spark.createDataFrame([(1, "good,BAD"), (2, "bad"), (3, None), (4, "fine")], "id long, v string")
    got = {x.id: (x.cleaned, x.changed) for x in filters.clean_values(df, "v", spark.createDataFrame([("bad",)], "value string")).collect()}
    assert got == {1: ("good", True), 2: ("", True), 3: (None, False), 4: ("fine", False)}


def test_first_sight(spark):
    df = spark.createDataFrame([(1, "e", "A", 1), (2, "e", "B", 2), (3, "e", "A", 3)], "id long, entity string, place string, ts long")
    assert [x.label for x in r.new_to_town(df, "entity", "place", "ts", "id").orderBy("id").collect()] == ["new to data", "new to town", "local"]


def test_csv_drops_rows_of_another_width(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,"a ""q"", b"\n2\n3,c\n')
    assert [tuple(x) for x in s.read_csv(spark, str(tmp_path), "id int, name string").orderBy("id").collect()] == [(1, 'a "q", b'), (3, "c")]


def test_lexicon_is_seeded_once(spark):
    name = "lexicon_for_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        assert s.ensure_lexicon(spark, name, spark.createDataFrame([("a", "x")], "keyword string, class string")).count() == 1
        assert s.ensure_lexicon(spark, name, spark.createDataFrame([("b", "y"), ("c", "y")], "keyword string, class string")).count() == 1
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_snapshots_only_move_forward(spark, tmp_path):
    at = lambda y: spark.createDataFrame([(1, datetime.datetime(y, 1, 1))], "id int, mod_ts timestamp")
    root = f"file://{tmp_path}/s"
    assert s.publish_snapshot(spark, at(2020), root, "t") and s.publish_snapshot(spark, at(2022), root, "t")
    assert not s.publish_snapshot(spark, at(2021), root, "t") and not s.publish_snapshot(spark, at(2022).limit(0), root, "t")
    assert s.read_snapshot(spark, root, "t").first().mod_ts.year == 2022


def test_of_several_publishers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/s"
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda i: s.put_if_absent(spark, f"{root}/x", str(i)), range(24))) == [False] * 23 + [True]
    at = lambda y, n: spark.createDataFrame([(n, datetime.datetime(y, 1, 1)), (n, datetime.datetime(y - 1, 1, 1))], "id int, mod_ts timestamp")
    for year in (2020, 2021):
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda n, year=year: s.publish_snapshot(spark, at(year, n), root, "t"), range(4)))
        rows = s.read_snapshot(spark, root, "t").collect()
        assert won.count(True) == 1 and {r.id for r in rows} == {won.index(True)} and len(rows) == 2 and max(r.mod_ts.year for r in rows) == year
    assert s.active_version(spark, root, "t")["version"] == 1
    assert len([p for p in (tmp_path / "s" / "t").iterdir()]) == 2  # what lost is gone


def test_listing_and_json(spark):
    assert s.describe_datasets(spark, SF, ["nation"]).count() == 3
    row = spark.createDataFrame([(1, {"a": 2})], "cluster_id long, m map<string,long>")
    assert s.profiles_to_json(row).first().json == '{"cluster_id":1,"m":{"a":2}}'


def test_stream_linking_equals_batch(spark, tmp_path):
    """Six batches of two runs; what a batch reads is a few runs, whatever came before."""
    rows = [[(10 * n + i, "a", f"v{(n * 3 + i) % 5}") for i in range(3)] + [(10 * n, "a", "x"), (10 * n, "a", "x"), (10 * n + 5, "a", None)] for n in range(6)]
    schema = "record_id long, attribute string, value string"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n % 2:
            v.link_stream(v.stream_table(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/m", f"{tmp_path}/h", f"{tmp_path}/c", fanout=2)
    got = v.read_members(spark, f"{tmp_path}/m").collect()
    whole = k.link_best_match(spark.createDataFrame(sum(rows, []), schema))
    assert {x.record_id: x.cluster_id for x in got} == {x.record_id: x.cluster_id for x in whole.collect()} and len(got) == 18
    assert len(list((tmp_path / "h").iterdir())) <= 5
    assert v.read_members(spark, f"{tmp_path}/none").count() == 0


def test_runs():
    assert v.runs(0, 4) == [] and v.runs(27, 4) == [(0, 16), (16, 4), (20, 4), (24, 1), (25, 1), (26, 1)]
    for count in range(1, 200):
        found = v.runs(count, 4)
        assert sum(n for _, n in found) == count and [f for f, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and len(found) <= 12


def at_day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def test_volume_state_ends(spark, tmp_path):
    """A key for each day and batch: state goes once the watermark has passed, late rows are left out, and changed days alone are written."""
    schema = "ts timestamp, kind string"
    batches = [[(at_day(n, h), f"k{h}") for h in range(6)] + ([(None, "k0")] if n == 10 else []) for n in (0, 10, 20, 30)] + [[(at_day(2), "late"), (at_day(30), "k1")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sizes = v.run_available(v.windowed_volume(v.stream_table(spark, f"{tmp_path}/in", schema, 1), "ts", ["kind"], "1 day"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert max(sizes) <= 13 and sizes[-1] < max(sizes) + 1 and len(sizes) >= 5
    got = {(r.day, r.kind): r["count"] for r in v.read_latest(spark, f"{tmp_path}/out", ["day", "kind"]).collect()}
    assert got == {(at_day(n).date(), f"k{h}"): 1 + (n == 30 and h == 1) for n in (0, 10, 20, 30) for h in range(6)}


def test_labels_forget(spark, tmp_path):
    schema = "id long, who string, town string, ts timestamp"
    batches = [
        [(1, "a", "x", at_day(0)), (2, "a", "y", at_day(0, 1)), (3, "a", "x", at_day(1)), (4, "b", None, at_day(0)), (5, "b", None, at_day(0)), (6, None, "x", at_day(0)), (7, "a", "x", None)],
        [(8, "a", "z", at_day(5)), (9, "c", "x", at_day(5)), (10, "b", "x", at_day(5))],
        [(11, "a", "z", at_day(12)), (12, "a", "x", at_day(12)), (13, "b", "x", at_day(40))],
        [(14, "a", "x", at_day(41)), (15, "c", "x", at_day(41)), (16, "c", "x", at_day(42)), (17, "c", "x", at_day(1))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = v.stream_table(spark, f"{tmp_path}/in", schema, 1)
    sizes = v.run_available(v.labels(stream, "who", "town", "ts", "id", "1 day", "10 days"), f"{tmp_path}/out", f"{tmp_path}/c", "append")
    got = {r.id: r.label for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    data, town, local = "new to data", "new to town", "local"
    assert got == {1: data, 2: town, 3: local, 4: data, 5: local, 8: town, 9: data, 10: town, 11: local, 12: town, 13: data, 14: data, 15: data, 16: local}
    assert len(sizes) >= 4 and max(sizes) <= 3


def test_sound_keys(spark):
    rows = ["Knight, Philip", "Night Filip", "Schmidt", "Schmitt", "Robert Rupert", "", None, "Größe"]
    df = spark.createDataFrame([(x,) for x in rows], "v string")
    keys = {r.v: (r.m, r.p) for r in df.select("v", fx.sound_key(F.col("v")).alias("m"), fx.soundex_key(F.col("v")).alias("p")).collect()}
    assert keys["Knight, Philip"][0] == keys["Night Filip"][0] and keys["Schmidt"][1] == keys["Schmitt"][1]
    assert keys["Robert Rupert"][1] == "R163" and keys[""] == ("", "") and keys[None] == (None, None)
    got = {r.value: r.refined for r in ag.refine_column(df, "v", "phonetic").collect()}
    assert got["Schmitt"] == "Schmidt" and None not in got


def test_written_tables_and_their_removal(spark):
    from tracelink import session

    before = spark.conf.get(session._CLEANUP, None)
    out = session.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "for-test")
    assert out.count() == 7 and spark.conf.get(session._CLEANUP, None) == before
    path = out.inputFiles()[0]
    assert session.clear_work(spark) > 0 and session.clear_work(spark) == 0
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
