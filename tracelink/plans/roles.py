"""The given tables in the roles that the operators take, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.session import dealt


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark, sf):
    """Nations as places; coordinates and population follow from the key."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.col("r_name").alias("state"),
        ((F.col("n_nationkey") * 7) % 180 - 90).cast("double").alias("lat"), ((F.col("n_nationkey") * 29) % 360 - 180).cast("double").alias("lon"),
        ((F.col("n_nationkey") * 37) % 11 * 1000).cast("long").alias("population"),
    )


def records(spark, sf):
    """Orders as records with source, place and time."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("source"),
        F.col("n_name").alias("region"), F.col("n_nationkey").alias("place"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"),
    )


def members(spark, sf):
    """Customers as clusters of orders."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("record_id"))


def lines(spark, sf):
    """``idents`` as they come, repeated ones too."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit("part").alias("attribute"), F.col("l_partkey").cast("string").alias("value"))


def idents(spark, sf, by_record: bool = False):
    """Identifiers: the parts of all order lines. ``by_record`` deals them out by record first, to as many tasks as lines take, for joins of all of them by record."""
    own = lines(spark, sf)
    return (dealt(own, own.count(), "record_id") if by_record else own).distinct()


def hrefs(spark, sf):
    """Skewed identifiers: the link targets of pages."""
    h = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf, "pages").select(F.col("page_id").alias("record_id"), F.lit("href").alias("attribute"), h.alias("value")).distinct()


def cluster_values(spark, sf):
    """(cluster_id, attribute, value, count): identifiers of each customer's orders."""
    own = dealt(members(spark, sf).join(idents(spark, sf, True), "record_id"), table(spark, sf, "lineitem").count(), "cluster_id", "value")
    return own.groupBy("cluster_id", "attribute", "value").agg(F.count(F.lit(1)).alias("count"))


def ring_values(spark, sf):
    """(cluster_id, attribute, value) of ``cluster_values``, uncounted and repeated as they come: steps over shared values need no more."""
    return members(spark, sf).join(lines(spark, sf), "record_id").select("cluster_id", "attribute", "value")


def tags(spark, sf):
    """(record_id, tag, user): event types as tags of records."""
    return table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("tag"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"))


SQL = {
    "places": "places AS (SELECT n_nationkey AS place, n_name AS name, r_name AS state, CAST((n_nationkey * 7) % 180 - 90 AS DOUBLE) AS lat, CAST((n_nationkey * 29) % 360 - 180 AS DOUBLE) AS lon, CAST((n_nationkey * 37) % 11 * 1000 AS BIGINT) AS population FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "records": "records AS (SELECT o_orderkey AS record_id, o_custkey AS cluster_id, o_orderdate AS ts, o_orderpriority AS source, n_name AS region, n_nationkey AS place, o_orderstatus AS status, o_totalprice AS price, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "members": "members AS (SELECT o_custkey AS cluster_id, o_orderkey AS record_id FROM orders)",
    "idents": "idents AS (SELECT DISTINCT l_orderkey AS record_id, 'part' AS attribute, CAST(l_partkey AS VARCHAR) AS value FROM lineitem)",
    "hrefs": "hrefs AS (SELECT DISTINCT page_id AS record_id, 'href' AS attribute, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS value FROM pages)",
    "cluster_values": "cluster_values AS (SELECT cluster_id, attribute, value, count(*) AS count FROM members JOIN idents USING (record_id) GROUP BY ALL)",
    "tags": "tags AS (SELECT event_id AS record_id, event_type AS tag, 'u' || CAST(user_id AS VARCHAR) AS \"user\" FROM events)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the named roles as CTEs before ``body`` (which may go on with CTEs after a comma)."""
    head = ", ".join(SQL[n] for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body if body.startswith(',') else ' ' + body}"
