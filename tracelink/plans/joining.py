"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelink.operators import joins as j
from tracelink.plans.roles import cluster_values, idents, members, places, records, sql, table, tags

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return add


def hits(spark, sf):
    return records(spark, sf).where("price > 150000 AND source = '1-URGENT'").select("record_id")


HITS = ", hits AS (SELECT record_id FROM records WHERE price > 150000 AND source = '1-URGENT') "


def customer_profiles(spark, sf):
    return members(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("record_count"))


PROFILES = ", profiles AS (SELECT cluster_id, count(*) AS record_count FROM members GROUP BY 1) "


@query("d1_clusters_for_records", sql("records members", HITS + "SELECT DISTINCT cluster_id FROM members WHERE record_id IN (SELECT record_id FROM hits)"))
def d1(spark, sf):
    return j.clusters_for_records(members(spark, sf), hits(spark, sf))


@query("d2_cluster_match_counts", sql("records members", HITS + "SELECT cluster_id, count(DISTINCT record_id) AS matches FROM members WHERE record_id IN (SELECT record_id FROM hits) GROUP BY 1"))
def d2(spark, sf):
    return j.cluster_match_counts(members(spark, sf), hits(spark, sf))


@query("d3_records_in_clusters", sql("members", "SELECT * FROM (SELECT cluster_id, record_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) AS INT) AS rank FROM members WHERE cluster_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) WHERE rank <= 3"))
def d3(spark, sf):
    chosen = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("cluster_id"))
    return j.records_in_clusters(members(spark, sf), chosen, 3)


@query("d4_with_source", "SELECT c_custkey, c_nationkey, n_name AS source_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def d4(spark, sf):
    sources = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return j.with_source(table(spark, sf, "customer"), sources, "c_nationkey").select("c_custkey", "c_nationkey", "source_name")


@query("d5_clusters_at", sql("records members", PROFILES + ", loc AS (SELECT region AS location, cluster_id, count(*) AS matches FROM records GROUP BY 1, 2) SELECT location, cluster_id, matches, record_count FROM loc JOIN profiles USING (cluster_id) WHERE location = 'NATION_3'"))
def d5(spark, sf):
    located = records(spark, sf).groupBy(F.col("region").alias("location"), "cluster_id").agg(F.count(F.lit(1)).alias("matches"))
    return j.profiles_at(located, customer_profiles(spark, sf), "NATION_3").select("location", "cluster_id", "matches", "record_count")


@query("d6_attributes_at", sql("records idents", ", p AS (SELECT value, count(*) AS record_count FROM idents GROUP BY 1), loc AS (SELECT region AS location, value, count(*) AS matches FROM records JOIN idents USING (record_id) GROUP BY 1, 2) SELECT location, value, matches, record_count FROM loc JOIN p USING (value) WHERE location = 'NATION_3'"))
def d6(spark, sf):
    own = idents(spark, sf)
    located = records(spark, sf).join(own, "record_id").groupBy(F.col("region").alias("location"), "value").agg(F.count(F.lit(1)).alias("matches"))
    return j.profiles_at(located, own.groupBy("value").agg(F.count(F.lit(1)).alias("record_count")), "NATION_3", "value").select("location", "value", "matches", "record_count")


@query("d7_with_scores", sql("members", PROFILES + "SELECT cluster_id, record_count, round(c_acctbal / 7, 2) AS score FROM profiles LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = cluster_id"))
def d7(spark, sf):
    scores = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cluster_id"), (F.col("c_acctbal") / 7).alias("score"))
    return j.with_scores(customer_profiles(spark, sf), scores)


@query("d8_clusters_for_search", sql("records members", HITS + PROFILES + "SELECT cluster_id, count(DISTINCT record_id) AS matches, any_value(record_count) AS record_count FROM members JOIN hits USING (record_id) JOIN profiles USING (cluster_id) GROUP BY 1"))
def d8(spark, sf):
    return j.clusters_for_search(hits(spark, sf), members(spark, sf), customer_profiles(spark, sf))


@query("d9_attributes_for_search", sql("records idents", HITS + "SELECT attribute, lower(value) AS value, count(DISTINCT record_id) AS matches FROM idents WHERE record_id IN (SELECT record_id FROM hits) GROUP BY 1, 2"))
def d9(spark, sf):
    return j.attributes_for_search(hits(spark, sf), idents(spark, sf))


@query("d10_with_demographics", sql("places", ", m AS (SELECT n_name AS name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT place, name, customers, balance FROM places JOIN m USING (name)"))
def d10(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    m = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    return j.with_demographics(places(spark, sf), m, ["customers", "balance"]).select("place", "name", "customers", "balance")


@query("d11_allow_features", sql("idents", "SELECT record_id, value FROM idents WHERE CAST(value AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size > 25)"))
def d11(spark, sf):
    return j.allow_features(idents(spark, sf), table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("value"))).select("record_id", "value")


_PAIRS = "SELECT a.attribute AS attr1, a.value AS val1, b.attribute AS attr2, b.value AS val2, count(*) AS count FROM idents a JOIN idents b ON a.record_id = b.record_id AND (a.attribute, a.value) {} (b.attribute, b.value) GROUP BY ALL"


@query("d12_attribute_links", sql("idents", _PAIRS.format("<>")))
def d12(spark, sf):
    return j.attribute_links(idents(spark, sf, by_record=True))


@query("d13_attribute_links_undirected", sql("idents", _PAIRS.format("<")))
def d13(spark, sf):
    return j.attribute_links(idents(spark, sf, by_record=True), directed=False)


@query("d14_cluster_links", sql("members idents cluster_values", "SELECT a.cluster_id, b.cluster_id AS other_id, a.attribute, a.value FROM cluster_values a JOIN cluster_values b ON a.attribute = b.attribute AND a.value = b.value AND b.cluster_id < a.cluster_id"))
def d14(spark, sf):
    return j.cluster_links(cluster_values(spark, sf))


_LONG = """, l AS (SELECT m.cluster_id, attribute, value FROM members m JOIN (SELECT l_orderkey AS record_id, l_partkey AS part, l_partkey || '-' || CAST(l_quantity AS INT) AS lot FROM lineitem) USING (record_id), LATERAL (VALUES ('part', CAST(part AS VARCHAR)), ('lot', lot)) AS e(attribute, value)),
k AS (SELECT * FROM l WHERE (attribute, value) NOT IN (SELECT (attribute, value) FROM l GROUP BY attribute, value HAVING count(*) > 40)), c AS (SELECT cluster_id, attribute, value, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT a.cluster_id, b.cluster_id AS other_id, a.attribute, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM c a JOIN c b ON a.attribute = b.attribute AND a.value = b.value AND b.cluster_id < a.cluster_id GROUP BY ALL)
SELECT cluster_id, other_id, 'one' AS criterion, 0.25 AS weight, shared FROM s WHERE attribute = 'part' UNION ALL SELECT cluster_id, other_id, 'both', 0.75, CAST(sum(shared) AS BIGINT) FROM s GROUP BY cluster_id, other_id HAVING count(*) = 2"""


@query("d15_link_by_criteria", f"SELECT cluster_id, other_id, criterion, CAST(weight AS DOUBLE) AS weight, shared FROM ({sql('members', _LONG)})")
def d15(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("part"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("lot"))
    return j.link_by_criteria(members(spark, sf), rows, [("one", 1, ["part"]), ("both", 3, ["part", "lot"])], 40)


@query("d16_expand_existing", sql("members idents cluster_values", ", shown AS (SELECT c_custkey AS cluster_id FROM customer WHERE c_acctbal > 9000) SELECT a.cluster_id, b.cluster_id AS new_id, a.attribute, a.value FROM cluster_values a JOIN cluster_values b USING (attribute, value) WHERE a.cluster_id IN (SELECT cluster_id FROM shown) AND b.cluster_id NOT IN (SELECT cluster_id FROM shown)"))
def d16(spark, sf):
    shown = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("cluster_id"))
    return j.expand_existing(shown, cluster_values(spark, sf))


@query("d17_similar_pairs", "WITH t AS (SELECT DISTINCT p_brand AS block, p_name AS text FROM part) SELECT a.block, a.text AS a, b.text AS b, levenshtein(a.text, b.text) / CAST(greatest(length(a.text), length(b.text)) AS DOUBLE) AS distance FROM t a JOIN t b ON a.block = b.block AND a.text < b.text WHERE levenshtein(a.text, b.text) / CAST(greatest(length(a.text), length(b.text)) AS DOUBLE) < 0.4")
def d17(spark, sf):
    return j.similar_pairs(table(spark, sf, "part"), "p_name", "p_brand", 0.4)


_WHERE = "CASE WHEN s_suppkey % 3 = 0 THEN 'Old Town, ' || n_name || ', ' || r_name WHEN s_suppkey % 3 = 1 THEN n_name ELSE 'Nowhere, ' || r_name END"


@query("d18_geocode", sql("places", f", t AS (SELECT s_suppkey AS k, {_WHERE} AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), q AS (SELECT k, trim(unnest(string_split(lower(w), ','))) AS part FROM t), c AS (SELECT k, place, name, 'city' AS found_as, row_number() OVER (PARTITION BY k ORDER BY lower(state) IN (SELECT part FROM q x WHERE x.k = q.k) DESC, population DESC, place) AS r FROM q JOIN places ON part = lower(name)) SELECT k, place, name, found_as FROM c WHERE r = 1 UNION ALL SELECT k, NULL, state, 'state' FROM (SELECT DISTINCT k, state FROM q JOIN places ON part = lower(state)) WHERE k NOT IN (SELECT k FROM c)"))
def d18(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("k"), F.expr(_WHERE).alias("w"))
    return j.geocode(rows, places(spark, sf), "k", "w")


@query("d19_resolve_locations", sql("places", ", t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'nation_' || (c_custkey % 40) END AS a, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS b, 'nation_4' AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce(x.name, y.name, z.name) AS label, coalesce(x.lat, y.lat, z.lat) AS lat, coalesce(x.lon, y.lon, z.lon) AS lon, CASE WHEN x.name IS NOT NULL THEN 0 WHEN y.name IS NOT NULL THEN 1 ELSE 2 END AS step FROM t LEFT JOIN places x ON lower(x.name) = a LEFT JOIN places y ON lower(y.name) = lower(b) LEFT JOIN places z ON lower(z.name) = c WHERE coalesce(x.name, y.name, z.name) IS NOT NULL"))
def d19(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("c_custkey")
    return j.resolve_locations(c.join(n, c.c_nationkey == n.n_nationkey), places(spark, sf), "c_custkey", [F.when(k % 4 == 0, F.concat(F.lit("nation_"), (k % 40).cast("string"))), F.when(k % 2 == 0, F.col("n_name")), F.lit("nation_4")])


@query("d20_clusters_for_fingerprint", sql("members", "SELECT DISTINCT cluster_id FROM members JOIN lineitem ON l_orderkey = record_id JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 9)"))
def d20(spark, sf):
    bins = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("hash"), F.col("p_brand").alias("bin"))
    own = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("record_id"))
    return j.clusters_for_fingerprint(bins, own, members(spark, sf), 9)


@query("d21_record_details", sql("records idents", ", i AS (SELECT record_id, string_agg(DISTINCT value, ',' ORDER BY value) AS parts FROM idents GROUP BY 1), f AS (SELECT l_orderkey AS record_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) SELECT record_id, region, price, parts, flags FROM records LEFT JOIN i USING (record_id) LEFT JOIN f USING (record_id)"))
def d21(spark, sf):
    flags = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("value"))
    return j.record_details(records(spark, sf).select("record_id", "region", "price"), {"parts": idents(spark, sf), "flags": flags})


@query("d22_records_for_attributes", sql("idents", "SELECT DISTINCT attribute, value, record_id FROM idents WHERE CAST(value AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')"))
def d22(spark, sf):
    chosen = table(spark, sf, "part").where("p_brand = 'Brand#13'").select(F.lit("part").alias("attribute"), F.col("p_partkey").cast("string").alias("value"))
    return j.records_for_attributes(idents(spark, sf), chosen)


@query("d23_bipartite_nodes", sql("idents", "SELECT DISTINCT 'r:' || CAST(record_id AS VARCHAR) AS id, 'record' AS kind FROM idents UNION ALL SELECT DISTINCT 'v:' || attribute || ':' || value, 'value' FROM idents"))
def d23(spark, sf):
    return j.bipartite_graph(idents(spark, sf))[0]


@query("d24_cluster_rows", sql("records members tags", ", t AS (SELECT record_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY 1) SELECT cluster_id, record_id, region, tags FROM members JOIN records USING (record_id, cluster_id) LEFT JOIN t USING (record_id)"))
def d24(spark, sf):
    return j.cluster_rows(members(spark, sf), records(spark, sf).select("record_id", "region"), tags(spark, sf))


@query("d25_unresolved_places", "WITH t AS (SELECT DISTINCT c_mktsegment || ', ' || CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Atlantis' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT name, 'Atlantis' AS country FROM t WHERE name LIKE '%Atlantis'")
def d25(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = F.concat("c_mktsegment", F.lit(", "), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise("Atlantis"))
    return j.unresolved_places(c.join(n, c.c_nationkey == n.n_nationkey).select(name.alias("where")), "where", places(spark, sf))
