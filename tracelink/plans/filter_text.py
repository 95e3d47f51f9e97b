"""Queries of filters, searches and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelink.functions import text as fx
from tracelink.operators import filters as f
from tracelink.plans.roles import idents, members, places, records, sql, table, tags

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return add


@query("b1_apply_filters", sql("records", "SELECT record_id, source, price FROM records WHERE price > 150000 AND lower(source) <> '5-low' AND lower(region) >= 'f' AND lower(status) LIKE '%f%'"))
def b1(spark, sf):
    return f.apply_filters(records(spark, sf), [("price", ">", 150000), ("source", "!=", "5-LOW"), ("region", ">=", "F"), ("status", "contains", "F")]).select("record_id", "source", "price")


@query("b3_match_criteria", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND contains(c_name, '7')")
def b3(spark, sf):
    return f.match_criteria(table(spark, sf, "customer"), [("c_mktsegment", "equals", "building"), ("c_name", "contains", "7")]).select("c_custkey", "c_name")


_B4 = sql("records members tags", ", own AS (SELECT m.cluster_id, m.record_id, {test} AS t, record_id IN (SELECT record_id FROM tags WHERE tag IN ('click', 'purchase')) AS tagged FROM members m JOIN records r USING (record_id)) SELECT cluster_id, count(DISTINCT record_id) AS size FROM own GROUP BY cluster_id HAVING {having}")


@query("b4_filter_clusters_any", _B4.format(test="coalesce(price > 200000, false) AND lower(source) = '1-urgent'", having="count(DISTINCT record_id) >= 3 AND bool_or(t) AND bool_or(tagged)"))
def b4(spark, sf):
    return f.filter_clusters(members(spark, sf), records(spark, sf).drop("cluster_id"), [("price", ">", 200000), ("source", "=", "1-URGENT")], tags(spark, sf), ["click", "purchase"], 3)


@query("b5_filter_clusters_each", sql("records members", "SELECT cluster_id, count(DISTINCT record_id) AS size FROM members JOIN records r USING (record_id, cluster_id) GROUP BY cluster_id HAVING bool_or(coalesce(price > 200000, false)) AND bool_or(lower(source) = '1-urgent')"))
def b5(spark, sf):
    return f.filter_clusters(members(spark, sf), records(spark, sf).drop("cluster_id"), [("price", ">", 200000), ("source", "=", "1-URGENT")], mode="each")


@query("b6_select_with_enrichment", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def b6(spark, sf):
    return f.select_with_enrichment(table(spark, sf, "documents"), ["lang"], [table(spark, sf, "labels")], "doc_id")


@query("b7_rows_for_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def b7(spark, sf):
    return f.rows_for_ids(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang", "source")


@query("b8_search_digits", sql("idents", "SELECT DISTINCT record_id FROM idents WHERE contains(value, '17')"))
def b8a(spark, sf):
    return f.search(records(spark, sf), idents(spark, sf), places(spark, sf), "(1)-7")


@query("b8_search_place", sql("records", "SELECT record_id FROM records WHERE contains(lower(region), 'nation_2')"))
def b8b(spark, sf):
    return f.search(records(spark, sf).withColumn("text", F.lit("")), idents(spark, sf), places(spark, sf), "Nation_2")


_WORDS = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("b8_search_text", f"SELECT doc_id AS record_id FROM documents WHERE len([t FOR t IN {_WORDS.format('text')} IF starts_with(t, 'lic')]) > 0")
def b8c(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text", F.lit("").alias("region"))
    return f.search(docs, idents(spark, sf), places(spark, sf), "Lic")


@query("b9_text_search", f"SELECT doc_id FROM documents WHERE len([t FOR t IN {_WORDS.format("concat_ws(' ', text, source)")} IF starts_with(t, 'thin')]) > 0 AND len([t FOR t IN {_WORDS.format("concat_ws(' ', text, source)")} IF starts_with(t, 'src1')]) > 0")
def b9(spark, sf):
    return f.text_search(table(spark, sf, "documents"), ["text", "source"], ["thin", "src1"]).select("doc_id")


@query("b10_lookup_identifiers", sql("idents", ", raw AS (SELECT 'No. ' || CAST(p_partkey AS VARCHAR) AS raw FROM part WHERE p_size = 7) SELECT record_id, attribute, value FROM idents WHERE value IN (SELECT regexp_replace(raw, '[^0-9]', '', 'g') FROM raw)"))
def b10(spark, sf):
    raw = table(spark, sf, "part").where("p_size = 7").select(F.concat(F.lit("No. "), F.col("p_partkey").cast("string")).alias("raw"))
    return f.lookup_identifiers(idents(spark, sf), raw).select("record_id", "attribute", "value")


@query("b11_search_values", sql("idents", "SELECT record_id, value FROM idents WHERE attribute = 'part' AND contains(value, '99')"))
def b11(spark, sf):
    return f.search_values(idents(spark, sf), "part", "99", exact=False).select("record_id", "value")


@query("b12_within_extent", sql("places", "SELECT name, lat, lon FROM places WHERE lat BETWEEN -60 AND 60 AND (lon >= 120 OR lon <= -120)"))
def b12(spark, sf):
    return f.within_extent(places(spark, sf), 120, -120, -60, 60).select("name", "lat", "lon")


@query("b13_within_days", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def b13(spark, sf):
    return f.within_days(table(spark, sf, "events"), "2024-01-05", "2024-01-09").select("event_id", "event_type")


@query("b14_clean_values", "WITH w AS (SELECT o_orderkey AS id, replace(o_orderpriority, '-', ',') || ',' || o_orderstatus AS v FROM orders), c AS (SELECT id, v, array_to_string([x FOR x IN string_split(v, ',') IF lower(trim(x)) NOT IN ('f', 'low')], ',') AS cleaned FROM w) SELECT id, v, cleaned, cleaned <> v AS changed FROM c")
def b14(spark, sf):
    wide = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(",", F.replace("o_orderpriority", F.lit("-"), F.lit(",")), "o_orderstatus").alias("v"))
    return f.clean_values(wide, "v", spark.createDataFrame([("F",), ("LOW",)], "value string"))


@query("b15_audit_values", "WITH v AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS value FROM pages) SELECT value, count(*) AS count FROM v WHERE length(value) >= 3 AND NOT regexp_matches(value, '^http') GROUP BY value HAVING count(*) > 1")
def b15(spark, sf):
    return f.audit_values(table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("value")))


@query("b16_rewrite", sql("records", "SELECT record_id, CASE WHEN source = '1-URGENT' AND price > 100000 THEN 'TOP ' || region WHEN status = 'O' THEN lower(region) ELSE region END AS region FROM records"))
def b16(spark, sf):
    rules = [((F.col("source") == "1-URGENT") & (F.col("price") > 100000), F.concat(F.lit("TOP "), F.col("region"))), (F.col("status") == "O", F.lower("region"))]
    return f.rewrite(records(spark, sf), "region", rules).select("record_id", "region")


@query("b17_distinct_for_clusters", sql("records members", "SELECT DISTINCT source FROM records JOIN members USING (record_id, cluster_id) WHERE cluster_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY source LIMIT 3"))
def b17(spark, sf):
    chosen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cluster_id"))
    return f.distinct_for_clusters(members(spark, sf), records(spark, sf), chosen, "source", 3)


# scalar functions over whole tables


@query("c1_extract_fields", """SELECT doc_id, CASE WHEN length(e) > 45 THEN substr(e, 1, 44) ELSE e END AS email, CASE WHEN length(n) > 45 THEN substr(n, 1, 44) ELSE n END AS number FROM (SELECT doc_id,
CASE WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN regexp_extract(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+', 0) END AS e,
nullif(regexp_replace(CASE WHEN regexp_matches(text, '[+]([0-9]+[- ][0-9- ]+)') THEN regexp_extract(text, '[+]([0-9]+[- ][0-9- ]+)', 1) WHEN regexp_matches(text, '([0-9]{7,})') THEN regexp_extract(text, '([0-9]{7,})', 1) END, '[^0-9]', '', 'g'), '') AS n FROM documents)""")
def c1(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", fx.first_match(t, [("[A-Za-z0-9.]+@[A-Za-z0-9.]+", 0)]).alias("email"), fx.first_match(t, [("[+]([0-9]+[- ][0-9- ]+)", 1), ("([0-9]{7,})", 1)], digits_only=True).alias("number"))


@query("c5_digits", "SELECT page_id, nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS d FROM pages")
def c5(spark, sf):
    return table(spark, sf, "pages").select("page_id", fx.digits(F.col("url")).alias("d"))


_SPELL = "lower(p_name || ' ' || p_type || ' ' || CAST(p_size * 12345 AS VARCHAR))"
for _i, _w in enumerate(fx.NUMBER_WORDS):
    _SPELL = f"replace({_SPELL}, '{_w}', '{_i}')"


@query("c6_phone_key", f"SELECT p_partkey, CASE WHEN length(d) >= 7 THEN d ELSE '' END AS k FROM (SELECT p_partkey, regexp_replace({_SPELL}, '[^0-9]', '', 'g') AS d FROM part)")
def c6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fx.phone_key(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") * 12345).cast("string"))).alias("k"))


_STRIP = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"


@query("c9_strip_html", f"SELECT page_id, {_STRIP} AS t FROM pages")
def c9(spark, sf):
    return table(spark, sf, "pages").select("page_id", fx.strip_html(F.col("html")).alias("t"))


@query("c10_split_values", "SELECT doc_id, unnest([v FOR v IN [trim(x) FOR x IN string_split(lower(regexp_replace(text, '<[^>]*>', '', 'g')), ',')] IF length(v) >= 4 AND NOT contains(v, 'the ')]) AS v FROM documents")
def c10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(fx.split_values(F.col("text"), 4, ("the ",))).alias("v"))


@query("c11_clean_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '&[a-z0-9#]+;', ' ', 'g'), '[0-9]+ (?:views|posts)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents")
def c11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.clean_text(F.col("text")).alias("t"))


@query("c12_url_subdomain", "SELECT page_id, nullif(regexp_extract(url, '//([^./]+)\\.', 1), '') AS site FROM pages")
def c12(spark, sf):
    return table(spark, sf, "pages").select("page_id", fx.url_subdomain(F.col("url")).alias("site"))


@query("c13_location_label", "SELECT c_custkey, CASE WHEN length(l) > 20 THEN right(l, 19) ELSE l END AS label FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN n_name || ' upon the long river' END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, nullif(concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN r_name END, 'XX'), '')) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def c13(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("c_custkey", fx.location_label(F.when(k % 3 == 1, F.col("c_mktsegment")), F.when(k % 3 == 0, F.concat(F.col("n_name"), F.lit(" upon the long river"))), F.when(k % 2 == 0, F.col("r_name")), F.lit("XX"), 20).alias("label"))


@query("c14_day_bucket", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('day', ts)::TIMESTAMP + to_hours(12 * (hour(ts) // 12)) AS half FROM events")
def c14(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.day_bucket(F.col("ts"), "utc").alias("day"), fx.day_bucket(F.col("ts"), "half_day").alias("half"))


@query("c15_content_hash", "SELECT doc_id, sha1(text) AS h FROM documents")
def c15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.content_hash(F.col("text")).alias("h"))


@query("c16_hex", "SELECT p_partkey, lower(hex(p_name)) AS h, p_name AS back FROM part")
def c16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fx.to_hex(F.col("p_name")).alias("h")).withColumn("back", fx.from_hex(F.col("h")).cast("string"))


@query("c17_composite_key", "SELECT o_orderkey, concat_ws('|', o_orderpriority, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, 'null'), CAST(o_custkey AS VARCHAR)) AS k FROM orders")
def c17(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.composite_key([F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), F.col("o_custkey")]).alias("k"))
