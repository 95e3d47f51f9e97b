"""Queries of volumes, profiles, distributions, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelink.functions import text as fx
from tracelink.operators import aggregate as a
from tracelink.operators import keywords as kw
from tracelink.operators import ranking as r
from tracelink.plans.roles import hrefs, idents, members, places, records, sql, table, tags

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return add


def located(spark, sf):
    return records(spark, sf).withColumnRenamed("region", "location")


def located_points(spark, sf):
    return records(spark, sf).drop("region").join(places(spark, sf).select("place", F.col("name").alias("location"), "lat", "lon"), "place")


FACETS = ["source", "status"]
_FACET_SQL = ", f AS (SELECT cluster_id, facet, value, count(DISTINCT record_id) AS count FROM records, LATERAL (VALUES ('source', coalesce(source, 'none')), ('status', CASE WHEN status = 'F' THEN 'none' ELSE status END)) AS e(facet, value) GROUP BY ALL) "


def own_records(spark, sf):
    """Records whose status F is taken as missing."""
    return records(spark, sf).drop("cluster_id").withColumn("status", F.when(F.col("status") != "F", F.col("status")))


def own_facets(spark, sf):
    return a.facet_counts(members(spark, sf), own_records(spark, sf), FACETS, ["cluster_id"])


@query("a4_count_containing", "SELECT CAST(count_if(contains(text, 'the')) AS BIGINT) AS n_0, CAST(count_if(contains(text, 'License')) AS BIGINT) AS n_1, CAST(count_if(contains(text, '@')) AS BIGINT) AS n_2 FROM documents")
def a4(spark, sf):
    return a.count_containing(table(spark, sf, "documents"), "text", ["the", "License", "@"])


@query("c2_suppress_conflicts", sql("idents", ", m AS (SELECT l_orderkey AS r, CAST(l_suppkey * 1000 + l_linenumber AS VARCHAR) AS v FROM lineitem), w AS (SELECT record_id, value || '00' AS value FROM idents) SELECT record_id, value FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE r = record_id AND length(v) >= 4 AND (contains(v, value) OR contains(value, v)))"))
def c2(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).cast("string").alias("value"))
    return a.suppress_conflicts(idents(spark, sf).select("record_id", F.concat("value", F.lit("00")).alias("value")), m, 4)


@query("c3_suppress_by_raw", "WITH d AS (SELECT doc_id AS record_id, regexp_extract(text, '[0-9]{4,}', 0) AS value FROM documents) SELECT record_id, value FROM d JOIN documents ON doc_id = record_id WHERE value <> '' AND NOT regexp_matches(regexp_extract(text, '(.{0,2}' || regexp_replace(value, '([0-9])', '\\1[^0-9a-zA-Z]*', 'g') || '.{0,2})', 1), ' [0-9]+ ')")
def c3(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text", F.regexp_extract("text", "[0-9]{4,}", 0).alias("value")).where("value <> ''")
    return a.suppress_by_raw(own, "text", " [0-9]+ ").select("record_id", "value")


@query("c4_build_identifiers", """WITH t AS (SELECT o_orderkey AS record_id, 'phone' AS attribute, '+1 (' || o_custkey || ') ' || CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders UNION SELECT o_orderkey, 'status', ' ' || o_orderstatus || o_orderpriority || ' ' FROM orders UNION SELECT l_orderkey, 'flag', l_returnflag FROM lineitem),
n AS (SELECT DISTINCT record_id, attribute, CASE WHEN attribute = 'phone' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE trim(value) END AS value FROM t) SELECT * FROM n WHERE length(value) > 1 AND (attribute <> 'phone' OR length(value) <= 9) AND NOT (attribute = 'status' AND value = 'F5-LOW')""")
def c4(spark, sf):
    o = table(spark, sf, "orders")
    phone = o.select(F.col("o_orderkey").alias("record_id"), F.lit("phone").alias("attribute"), F.concat(F.lit("+1 ("), F.col("o_custkey").cast("string"), F.lit(") "), F.floor("o_totalprice").cast("long").cast("string")).alias("value"))
    status = o.select(F.col("o_orderkey").alias("record_id"), F.lit("status").alias("attribute"), F.concat(F.lit(" "), "o_orderstatus", "o_orderpriority", F.lit(" ")).alias("value"))
    flag = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit("flag").alias("attribute"), F.col("l_returnflag").alias("value"))
    return a.build_identifiers(phone.unionByName(flag), status, spark.createDataFrame([("status", "F5-LOW")], "attribute string, value string"), 9)


_LEXICON = [("licen[cs]e", "law"), ("Copyright", "law"), ("@[a-z]", "contact"), ("(?:the|la|die) ", "word"), ("[0-9]{6}", "number")]


@query("c7_tag_keywords", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS keyword, '{c}' AS class, CAST(len(regexp_extract_all(text, '{k}')) AS BIGINT) AS count FROM documents WHERE length(text) >= 2 AND regexp_matches(text, '{k}')" for k, c in _LEXICON))
def c7(spark, sf):
    return kw.tag_keywords(table(spark, sf, "documents"), "doc_id", "text", spark.createDataFrame(_LEXICON, "keyword string, class string"))


_ASKED = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS keyword FROM benchmark"


@query("c7_tag_lexicon", f"WITH k AS MATERIALIZED ({_ASKED}) SELECT doc_id, keyword, 'asked' AS class, CAST((length(text) - length(replace(text, keyword, ''))) // length(keyword) AS BIGINT) AS count FROM documents JOIN k ON contains(text, keyword) WHERE length(text) >= 2")
def c7b(spark, sf):
    """A lexicon of thousands of literal keywords: the longer words of all benchmark items."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("keyword"), F.lit("asked").alias("class"))
    return kw.tag_keywords(table(spark, sf, "documents"), "doc_id", "text", words)


_FP = "array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ')"
_NAMES = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || '!' ELSE p_name END"


@query("c18_refine_fingerprint", f"WITH c AS (SELECT v AS value, count(*) AS n, {_FP.format('v')} AS key FROM (SELECT {_NAMES} AS v FROM part) GROUP BY v), b AS (SELECT key, arg_min(value, (-n, value)) AS refined FROM c GROUP BY 1) SELECT value, key, refined FROM c JOIN b USING (key)")
def c18a(spark, sf):
    return a.refine_column(table(spark, sf, "part").select(F.expr(_NAMES).alias("v")), "v")


_NG = "array_to_string(list_sort(list_distinct([substr(s, i, 3) FOR i IN range(1, greatest(1, length(s) - 2) + 1)])), '')"


@query("c18_refine_ngram", f"WITH c AS (SELECT v AS value, count(*) AS n, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS s FROM (SELECT {_NAMES} AS v FROM part) GROUP BY v), k AS (SELECT value, n, {_NG} AS key FROM c), b AS (SELECT key, arg_min(value, (-n, value)) AS refined FROM k GROUP BY 1) SELECT value, key, refined FROM k JOIN b USING (key)")
def c18b(spark, sf):
    return a.refine_column(table(spark, sf, "part").select(F.expr(_NAMES).alias("v")), "v", "ngram", 3)


def _sound_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g')"
    for pattern, replacement in fx.SOUNDS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"array_to_string(list_sort(list_distinct(string_split(trim({out}), ' '))), ' ')"


@query("c18_refine_metaphone", f"WITH c AS (SELECT v AS value, count(*) AS n, {_sound_sql('v')} AS key FROM (SELECT {_NAMES} AS v FROM part) GROUP BY v), b AS (SELECT key, arg_min(value, (-n, value)) AS refined FROM c GROUP BY 1) SELECT value, key, refined FROM c JOIN b USING (key)")
def c18c(spark, sf):
    return a.refine_column(table(spark, sf, "part").select(F.expr(_NAMES).alias("v")), "v", "metaphone")


@query("c18_refine_phonetic")
def c18d(spark, sf):
    return a.refine_column(table(spark, sf, "part").select(F.expr(_NAMES).alias("v")), "v", "phonetic")


@query("c19_minmax_scale", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def c19(spark, sf):
    return a.minmax_scale(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "scaled")


@query("e1_daily_volume", "SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events GROUP BY 1")
def e1(spark, sf):
    return a.daily_volume(table(spark, sf, "events"))


@query("e2_location_time_volume", sql("records places", "SELECT name AS location, CAST(ts AS DATE) AS day, arg_min(lat, record_id) AS lat, arg_min(lon, record_id) AS lon, count(*) AS count FROM records JOIN places USING (place) GROUP BY 1, 2"))
def e2(spark, sf):
    return a.location_time_volume(located_points(spark, sf))


@query("e3_location_volume", sql("records places", "SELECT name, lat, lon, count(*) AS count FROM records JOIN places ON lower(region) = lower(name) WHERE population > 2000 GROUP BY ALL"))
def e3(spark, sf):
    return a.location_volume(records(spark, sf), places(spark, sf).where("population > 2000"))


@query("e4_source_counts", "SELECT source, count(*) AS count FROM documents GROUP BY 1")
def e4(spark, sf):
    return a.source_counts(table(spark, sf, "documents"))


@query("e5_cluster_locations", sql("records members", "SELECT region AS location, cluster_id, count(*) AS matches FROM records GROUP BY 1, 2"))
def e5(spark, sf):
    return a.matches_per(members(spark, sf), located(spark, sf), "cluster_id")


@query("e6_attribute_locations", sql("records idents", "SELECT region AS location, attribute, value, count(*) AS matches FROM records JOIN idents USING (record_id) GROUP BY 1, 2, 3"))
def e6(spark, sf):
    return a.matches_per(idents(spark, sf), located(spark, sf), "attribute", "value")


@query("e7_cluster_profiles", sql("records", _FACET_SQL + ", p AS (SELECT cluster_id, count(*) AS record_count, max(CAST(ts AS DATE)) AS latest, count(DISTINCT CAST(ts AS DATE)) AS days FROM records GROUP BY 1) SELECT p.cluster_id, record_count, latest, days, facet, value, count FROM p JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id, facet ORDER BY count DESC, value) AS r FROM f WHERE length(value) >= 2) q USING (cluster_id) WHERE r <= 3"))
def e7(spark, sf):
    own = a.profiles(members(spark, sf), own_records(spark, sf), FACETS, ["cluster_id"], 3)
    return own.select("cluster_id", "record_count", "latest", F.size("series").cast("long").alias("days"), F.explode("facets").alias("facet", "top")).select("cluster_id", "record_count", "latest", "days", "facet", F.explode("top").alias("value", "count"))


@query("e8_attribute_profiles", sql("records idents", "SELECT attribute, value, count(DISTINCT record_id) AS record_count, max(CAST(ts AS DATE)) AS latest FROM idents JOIN records USING (record_id) GROUP BY 1, 2"))
def e8(spark, sf):
    return a.profiles(idents(spark, sf), own_records(spark, sf), FACETS, ["attribute", "value"]).select("attribute", "value", "record_count", "latest")


@query("e9_top_n", "SELECT event_type, value, count, rank FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS value, count(*) AS count, CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS INT) AS rank FROM events WHERE length(CAST(user_id AS VARCHAR)) >= 2 GROUP BY 1, 2) WHERE rank <= 5")
def e9(spark, sf):
    return a.top_n(a.count_of(table(spark, sf, "events"), "event_type", F.col("user_id").cast("string").alias("value")), ["event_type"], 5, 2)


@query("e10_cluster_names", sql("records", _FACET_SQL + ", b AS (SELECT cluster_id, facet, arg_min(value, (-count, value)) AS v, max(count) AS n FROM f WHERE value <> 'none' GROUP BY 1, 2), w AS (SELECT cluster_id, max(v) FILTER (facet = 'status') AS a, max(n) FILTER (facet = 'status') AS an, max(v) FILTER (facet = 'source') AS b, max(n) FILTER (facet = 'source') AS bn FROM b GROUP BY 1) SELECT cluster_id, CASE WHEN b IS NOT NULL AND (a IS NULL OR bn > 2 OR bn > an) THEN b ELSE coalesce(a, CAST(cluster_id AS VARCHAR)) END AS name FROM (SELECT DISTINCT cluster_id FROM f) LEFT JOIN w USING (cluster_id)"))
def e10(spark, sf):
    return a.cluster_names(own_facets(spark, sf), "status", "source", "region")


@query("e11_value_counts", "SELECT count(*) AS n_values, arg_min(v, (-n, v)) AS most, arg_min(v, (n, v)) AS least FROM (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1)")
def e11(spark, sf):
    return a.value_counts(table(spark, sf, "part"), "p_type")


@query("e12_count_distribution", "SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY 1")
def e12(spark, sf):
    return a.count_distribution(table(spark, sf, "orders"), "o_custkey")


@query("e13_top_values", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def e13(spark, sf):
    return a.top_values(table(spark, sf, "events"), "user_id", 10)


@query("e14_cluster_summary", "SELECT count(*) AS clusters, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def e14(spark, sf):
    return a.cluster_summary(members(spark, sf))


@query("e15_facet_summary", sql("records", _FACET_SQL + "SELECT facet, lower(value) AS value, count(DISTINCT cluster_id) AS clusters FROM f GROUP BY 1, 2"))
def e15(spark, sf):
    return a.facet_summary(own_facets(spark, sf))


@query("e15_facet_totals", sql("records", _FACET_SQL + "SELECT cluster_id, facet, CAST(sum(count) AS BIGINT) AS total, CAST(coalesce(sum(count) FILTER (value = 'none'), 0) AS BIGINT) AS none, max(count) FILTER (value <> 'none') AS largest FROM f GROUP BY 1, 2"))
def e15b(spark, sf):
    return a.facet_totals(own_facets(spark, sf))


@query("e16_select_by_facet", sql("records", _FACET_SQL + "SELECT cluster_id, bool_or(facet = 'source' AND lower(value) = '2-high') AS selected FROM f GROUP BY 1"))
def e16(spark, sf):
    return a.select_by_facet(a.profiles(members(spark, sf), own_records(spark, sf), FACETS, ["cluster_id"]), "source", "2-High").select("cluster_id", "selected")


@query("e17_value_shares", "WITH c AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_brand END AS value, count(*) AS count FROM part GROUP BY 1) SELECT value, count, round(count / sum(count) OVER (), 6) AS share FROM c WHERE NOT contains(value, '#2')")
def e17(spark, sf):
    return a.value_shares(table(spark, sf, "part").select(F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("v")), "v", ["#2"])


@query("e18_word_counts", "WITH w AS (SELECT lower(source) AS word FROM documents UNION ALL SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) FROM documents) SELECT word, count(*) AS count FROM w WHERE length(word) >= 3 AND word NOT IN ('the', 'and', 'that') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def e18(spark, sf):
    stop = spark.createDataFrame([("the",), ("AND",), ("that",)], "word string")
    return a.word_counts(table(spark, sf, "documents"), ["source"], ["text"], stop)


@query("e19_merge_timeseries", sql("records", "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS count FROM records GROUP BY 1"))
def e19(spark, sf):
    return a.merge_timeseries(a.profiles(members(spark, sf), own_records(spark, sf), FACETS, ["cluster_id"]))


@query("e20_related_locations", "WITH l AS (SELECT DISTINCT l_suppkey AS cluster_id, p_brand AS location FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT location, count(DISTINCT cluster_id) AS clusters FROM l WHERE location <> 'Brand#11' AND cluster_id IN (SELECT cluster_id FROM l WHERE location = 'Brand#11') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def e20(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    own = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("cluster_id"), F.col("p_brand").alias("location"))
    return a.related_locations(own, "Brand#11")


_SEG = "CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"


@query("e21_segment_series", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"CAST(coalesce(sum({e}) FILTER ({_SEG} = {k}), 0) AS {t}) AS {n}_{m}" for k, n in enumerate(("total", "local", "town", "data")) for m, e, t in (("count", "1", "BIGINT"), ("expected", "user_id", "BIGINT"))) + " FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def e21(spark, sf):
    own = table(spark, sf, "events").select((F.col("user_id") % 2).alias("location"), F.to_date("ts").alias("day"), F.expr(_SEG).alias("segment"), F.lit(1).cast("long").alias("count"), F.col("user_id").alias("expected"))
    return a.segment_series(own, 0, {0: "total", 1: "local", 2: "town", 3: "data"}, ["count", "expected"])


@query("e22_period_change", sql("records", ", v AS (SELECT region AS location, CAST(ts AS DATE) AS day, count(*) AS count FROM records GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY count, day) AS r, count(*) OVER (PARTITION BY location) AS n FROM v), y AS (SELECT location, CAST(coalesce(sum(count) FILTER (day BETWEEN DATE '1996-03-01' AND DATE '1996-06-08'), 0) AS BIGINT) AS total, avg(count) FILTER (r > floor(n * 0.2) AND r <= greatest(ceil(n * 0.8), floor(n * 0.2) + 1)) AS usual FROM x GROUP BY 1) SELECT location, total, round(total / 100, 6) AS mean, round(usual, 6) AS usual, round(total / 100 - usual, 6) AS delta, round(total / 100 / usual, 6) AS ratio, CAST(sign(total / 100 - usual) AS INT) AS sign FROM y"))
def e22(spark, sf):
    return a.period_change(a.count_of(located(spark, sf), "location", F.to_date("ts").alias("day")), "1996-03-01", "1996-06-08")


@query("e23_time_histogram", "WITH t AS (SELECT epoch(ts)::BIGINT AS s FROM (SELECT date_trunc('second', ts) AS ts FROM events)), m AS (SELECT min(s) AS lo, max(s) AS hi FROM t), b AS (SELECT least(6, (s - lo) * 7 // greatest(1, hi - lo)) AS bucket FROM t, m) SELECT CAST(r AS INT) AS bucket, count(bucket) AS count FROM range(7) AS g(r) LEFT JOIN b ON bucket = r GROUP BY 1")
def e23(spark, sf):
    return a.time_histogram(table(spark, sf, "events"), "ts")


@query("e24_place_summary", sql("records places", ", p AS (SELECT name AS location, arg_min(lat, record_id) AS lat, arg_min(lon, record_id) AS lon, count(*) AS count, min(record_id) AS first_id FROM records JOIN places USING (place) GROUP BY 1) SELECT *, round(5.0 + (count - min(count) OVER ()) / (max(count) OVER () - min(count) OVER ()) * 20.0, 6) AS scaled FROM p"))
def e24(spark, sf):
    return a.place_summary(located_points(spark, sf))


@query("e25_sample_values", sql("members idents", ", d AS (SELECT DISTINCT cluster_id, value FROM members JOIN idents USING (record_id)), x AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY value) AS r FROM d) SELECT cluster_id, string_agg(value, ',' ORDER BY value) AS sample FROM x WHERE r <= 3 GROUP BY 1"))
def e25(spark, sf):
    return a.sample_values(members(spark, sf), idents(spark, sf), "value", 3)


@query("e26_largest_id", "SELECT max(o_orderkey) AS largest, count(*) AS rows FROM orders")
def e26(spark, sf):
    return a.largest_id(table(spark, sf, "orders"), "o_orderkey")


@query("e27_tag_counts", sql("members tags", "SELECT cluster_id, tag, count(DISTINCT record_id) AS count FROM members JOIN tags USING (record_id) GROUP BY 1, 2"))
def e27(spark, sf):
    return a.tag_counts(tags(spark, sf), members(spark, sf))


# rankings and set operations


@query("f1_top_places", sql("records", "SELECT region AS location, count(*) AS count FROM records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def f1(spark, sf):
    return r.top_places(a.count_of(located(spark, sf), "location"), "count", 10)


@query("f4_movement_timeline", sql("records", ", x AS (SELECT place, record_id, ts, row_number() OVER (PARTITION BY place ORDER BY ts, record_id) AS step, min(ts) OVER (PARTITION BY place) AS first_ts FROM records) SELECT place, record_id, CAST(step AS INT) AS step, first_ts::TIMESTAMP AS first_ts FROM x"))
def f4(spark, sf):
    return r.movement_timeline(records(spark, sf)).select("place", "record_id", "step", "first_ts")


@query("f5_order_profiles", sql("records", _FACET_SQL + ", t AS (SELECT cluster_id, CAST(sum(count) AS BIGINT) AS total, CAST(coalesce(sum(count) FILTER (value = 'none'), 0) AS BIGINT) AS none, max(count) FILTER (value <> 'none') AS largest FROM f WHERE facet = 'status' GROUP BY 1) SELECT cluster_id, CAST(row_number() OVER (ORDER BY cluster_id % 7 = 0 DESC, total - none DESC NULLS LAST, largest DESC NULLS LAST, cluster_id) AS BIGINT) AS position FROM t"))
def f5(spark, sf):
    own = a.facet_totals(own_facets(spark, sf)).where("facet = 'status'").withColumn("selected", F.col("cluster_id") % 7 == 0)
    return r.numbered(own, r.profile_order(own))


@query("f6_sample_members", sql("members", "SELECT cluster_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) AS r FROM members) WHERE r <= 2"))
def f6(spark, sf):
    return r.sample_members(members(spark, sf), 2)


@query("f7_new_to_town", "WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) SELECT event_id, CASE WHEN a = 1 THEN 'new to data' WHEN b = 1 THEN 'new to town' ELSE 'local' END AS label FROM e")
def f7(spark, sf):
    return r.new_to_town(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "label")


@query("f8_order_records", "SELECT page_id, CAST(row_number() OVER (ORDER BY n DESC, page_id) AS BIGINT) AS position FROM (SELECT page_id, len(regexp_extract_all(html, 'href=\"')) AS n FROM pages)")
def f8(spark, sf):
    own = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('(href=")'), F.lit(1)).alias("links"))
    return r.numbered(own, r.record_order(own, "links", True, "page_id"), "page_id")


@query("g1_union_links", sql("idents hrefs", "SELECT record_id, attribute, value FROM idents UNION ALL SELECT record_id, attribute, value FROM hrefs"))
def g1(spark, sf):
    return r.union_links(idents(spark, sf), hrefs(spark, sf))


@query("g3_shared_records", "SELECT l_orderkey AS record_id FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey = 2")
def g3(spark, sf):
    li = table(spark, sf, "lineitem")
    return r.shared_records(*[li.where(F.col("l_suppkey") == s).select(F.col("l_orderkey").alias("record_id")) for s in (1, 2)])


@query("g4_exclude", sql("members", "SELECT cluster_id, record_id FROM members WHERE cluster_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def g4(spark, sf):
    return r.exclude(members(spark, sf), table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("cluster_id")), "cluster_id")


@query("g5_merge_tables", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def g5(spark, sf):
    return r.merge_tables(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("g6_merge_graphs", "SELECT c_custkey AS id, 0 AS ring FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 4 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def g6(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("ring"))
    e = spark.createDataFrame([], "src long, dst long")
    return r.merge_graphs((c.where("id % 3 = 0"), e), (c.where("id % 2 = 0"), e))[0]


@query("g7_all_tags", sql("tags", "SELECT DISTINCT tag FROM tags"))
def g7(spark, sf):
    return r.all_tags(tags(spark, sf))
