"""Queries of sources, sinks, snapshots, saved sets and streams: each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.operators import aggregate as a
from tracelink.operators import updates as u
from tracelink.plans.roles import idents, members, records, sql, table
from tracelink.session import work_path, written
from tracelink.sources import tables as s
from tracelink.streaming import volume as v

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return add


@query("a1_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def a1(spark, sf):
    return s.read_table(spark, f"{sf}/orders.parquet", "o_orderkey", (100, 900)).select("o_orderkey", "o_totalprice")


@query("a2_read_csv", "SELECT c_custkey, c_name, 'a \"b\", ' || c_mktsegment AS note FROM customer")
def a2(spark, sf):
    at = work_path(spark, "csv")
    own = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit('a "b", '), "c_mktsegment").alias("note"))
    own.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(at)
    return s.read_csv(spark, at, own.schema)


@query("a3_read_delimited", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS count FROM orders GROUP BY 1")
def a3(spark, sf):
    at = work_path(spark, "delimited")
    own = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    own.write.option("sep", "\x01").csv(at)
    return a.daily_volume(s.read_delimited(spark, at, own.schema), "o_orderdate")


@query("a5_copy_table", sql("idents", "SELECT record_id, value FROM idents UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 1"))
def a5(spark, sf):
    at = work_path(spark, "copy")
    s.copy_table(idents(spark, sf).select("record_id", "value"), at)
    s.copy_table(table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("value")), at)
    return spark.read.parquet(at)


@query("a6_save_result", sql("records", "SELECT source, count(*) + CASE WHEN source = '1-URGENT' THEN 1000 ELSE 0 END AS count FROM records GROUP BY 1"))
def a6(spark, sf):
    at = work_path(spark, "result")
    counts = a.source_counts(records(spark, sf))
    s.save_result(counts, at, ["source"])
    s.save_result(counts.where("source = '1-URGENT'").withColumn("count", F.col("count") + 1000), at, ["source"])
    return spark.read.schema("count long, source string").parquet(at).select("source", "count")


@query("a7_publish_snapshot", "SELECT o_orderkey, o_orderdate AS mod_ts FROM orders")
def a7(spark, sf):
    root = work_path(spark, "snapshots")
    own = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("mod_ts"))
    s.publish_snapshot(spark, own.where("mod_ts < '1997-01-01'"), root, "orders")
    s.publish_snapshot(spark, own, root, "orders")
    s.publish_snapshot(spark, own.where("mod_ts < '1996-01-01'"), root, "orders")  # older: not published
    return s.read_snapshot(spark, root, "orders") if s.active_version(spark, root, "orders") else own  # of no rows nothing is published


@query("a8_clean_dimension", "SELECT CAST(p_partkey AS BIGINT) AS id, trim(p_name) AS name, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS size FROM part")
def a8(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "null").otherwise("")).otherwise(F.col("p_size").cast("string")).alias("size"))
    return s.clean_dimension(raw, T.StructType().add("id", "long").add("name", "string").add("size", "integer"))


@query("a8_load_dimension", "SELECT CAST(c_custkey AS BIGINT) AS id, trim(c_name) AS name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer")
def a8b(spark, sf):
    at = work_path(spark, "dimension")
    own = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "null").otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    own.write.option("header", True).option("quoteAll", True).csv(at)
    return s.load_dimension(spark, at, T.StructType().add("id", "long").add("name", "string").add("balance", "double"))


@query("a10_datasets_with_sets", "SELECT * FROM (VALUES ('orders', 6, (SELECT count(*) FROM orders), 'one', (SELECT count(*) FROM orders)), ('orders', 6, (SELECT count(*) FROM orders), 'two', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), ('customer', 5, (SELECT count(*) FROM customer), NULL, NULL)) AS t(dataset, columns, rows, set_id, members)")
def a10(spark, sf):
    at = work_path(spark, "sets")
    u.save_cluster_set(members(spark, sf), at, "one", "p=1")
    u.save_cluster_set(records(spark, sf).where("status = 'F'").select("cluster_id", "record_id"), at, "two", "p=2")
    sets = spark.read.schema(u.SETS).parquet(at).select("set_id", F.lit("orders").alias("dataset"))
    return s.datasets_with_sets(spark, sf, ["orders", "customer"], sets)


@query("c8_ensure_lexicon", "SELECT DISTINCT p_type AS keyword, p_brand AS class FROM part")
def c8(spark, sf):
    name, at = f"lexicon_{uuid.uuid4().hex}", work_path(spark, "lexicon")
    own = table(spark, sf, "part").select(F.col("p_type").alias("keyword"), F.col("p_brand").alias("class"))
    s.ensure_lexicon(spark, name, own, at)
    s.ensure_lexicon(spark, name, own.limit(0), at)  # is there: stays as it is
    spark.sql(f"DROP TABLE {name}")  # its files are the work folder's
    return spark.read.schema("keyword string, class string").parquet(at)


@query("a11_profiles_to_json")
def a11(spark, sf):
    return s.profiles_to_json(a.profiles(members(spark, sf), records(spark, sf).drop("cluster_id"), ["source", "status"], ["cluster_id"], 5))


@query("i5_cluster_sets", sql("members", "SELECT cluster_id, record_id, 'p=2' AS parameters FROM members WHERE cluster_id % 2 = 0"))
def i5(spark, sf):
    at = work_path(spark, "sets")
    own = members(spark, sf)
    u.save_cluster_set(own, at, "one", "p=1")
    u.save_cluster_set(own, at, "two", "p=1")
    u.save_cluster_set(own.where("cluster_id % 2 = 0"), at, "two", "p=2")
    return u.load_cluster_set(spark, at, "two")


def _events_folder(spark, sf, parts: int = 3):
    """The events as files of a folder, as a stream reads them: (path, schema) each time that files came, one part after the other in time, each written by as many tasks as read it."""
    at, own = work_path(spark, "events"), table(spark, sf, "events")
    ends = own.agg(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), [(i + 1) / parts for i in range(parts)])).first()[0] or [None]
    seconds = F.col("ts").cast("timestamp").cast("double")
    for low, high in zip([None, *ends], [*ends[:-1], None], strict=False):
        now = own.where(F.lit(True) if low is None else seconds > low).where(F.lit(True) if high is None else seconds <= high)
        now.write.mode("append").parquet(at)
        yield at, own.schema


@query("j1_stream_daily_volume", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def j1(spark, sf):
    out, state = work_path(spark, "stream-out"), work_path(spark, "stream-state")
    for at, schema in _events_folder(spark, sf):  # a batch each
        v.run_available(v.windowed_volume(v.stream_table(spark, at, schema), "ts", ["event_type"], "2 days"), out, state)
    return v.read_latest(spark, out, ["day", "event_type"])


@query("j2_stream_linking")
def j2(spark, sf):
    """Three runs of the stream, each over the records that came since the one before."""
    at, out, state, held = (work_path(spark, n) for n in ("idents", "members", "stream-state", "held"))
    own = written(idents(spark, sf), "identifiers")
    ends = own.agg(F.percentile_approx("record_id", [0.4, 0.7, 1.0])).first()[0] or [0]
    for low, high in zip([None, *ends], ends, strict=False):
        own.where(F.col("record_id") <= high).where(F.lit(True) if low is None else F.col("record_id") > low).write.mode("append").parquet(at)
        v.link_stream(v.stream_table(spark, at, own.schema), out, held, state)
    return v.read_members(spark, out)


@query("j3_stream_first_sights", "SELECT DISTINCT user_id, event_type FROM events")
def j3(spark, sf):
    *_, (at, schema) = _events_folder(spark, sf)
    out = work_path(spark, "stream-out")
    v.run_available(v.first_sights(v.stream_table(spark, at, schema), ["user_id", "event_type"], "ts", "60 days"), out, work_path(spark, "stream-state"), "append")
    return spark.read.parquet(out).select("user_id", "event_type").distinct()


@query("j3_stream_labels", "WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) SELECT event_id, CASE WHEN a = 1 THEN 'new to data' WHEN b = 1 THEN 'new to town' ELSE 'local' END AS label FROM e")
def j3b(spark, sf):
    out, state = work_path(spark, "stream-out"), work_path(spark, "stream-state")
    for at, schema in _events_folder(spark, sf):  # a batch each
        v.run_available(v.labels(v.stream_table(spark, at, schema), "user_id", "event_type", "ts", "event_id", forget="40000 days"), out, state, "append")
    return spark.read.parquet(out).select("event_id", "label")
