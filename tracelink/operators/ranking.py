"""Rankings, orders, limits and set operations.

Unless a function says otherwise: nulls come last in an order, in set operations a null equals a null, repeated rows are ranked each, ties go to the smaller
id, an empty table gives an empty result, and other columns are kept by filters and orders and ignored by the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.session import written


def top_places(volume: DataFrame, by: str = "count", n: int = 100) -> DataFrame:
    """The ``n`` largest places by ``count``, or by the square of a change column."""
    key = F.col(by) if by == "count" else F.col(by) * F.col(by)
    return volume.orderBy(key.desc_nulls_last(), "location").limit(n)


def order_nodes(nodes: DataFrame) -> DataFrame:
    """Graph order: inner rings first, larger nodes first."""
    return nodes.orderBy("ring", F.desc("size"), "id")


def movement_timeline(df: DataFrame, place: str = "place", ts: str = "ts", key: str = "record_id") -> DataFrame:
    """``df`` with step (order in time inside a place, unknown times last) and first_ts (the place's first time)."""
    own = Window.partitionBy(place)
    first = df.groupBy(place).agg(F.min(ts).alias("first_ts"))
    return df.withColumn("step", F.row_number().over(own.orderBy(F.asc_nulls_last(ts), key))).join(first, place).orderBy(F.asc_nulls_last("first_ts"), place, "step")


def profile_order(totals: DataFrame) -> list[Column]:
    """Selected first, then by the total without ``none``, then by the largest bar; nulls last, ties by cluster."""
    return [F.desc("selected"), (F.col("total") - F.col("none")).desc_nulls_last(), F.desc_nulls_last("largest"), F.asc("cluster_id")]


def order_profiles(totals: DataFrame) -> DataFrame:
    """Profiles in ``profile_order``."""
    return totals.orderBy(*profile_order(totals))


def record_order(df: DataFrame, column: str, desc: bool = True, key: str = "record_id") -> list[Column]:
    """By a column, empties last; a multi-valued column by its number of values; ties by ``key``."""
    kind = dict(df.dtypes)[column]
    value = F.size(column) if kind.startswith("array") else F.nullif(F.col(column), F.lit("")) if kind == "string" else F.col(column)
    return [value.desc_nulls_last() if desc else value.asc_nulls_last(), F.asc(key)]


def order_records(df: DataFrame, column: str, desc: bool = True, key: str = "record_id") -> DataFrame:
    """Records in ``record_order``."""
    return df.orderBy(*record_order(df, column, desc, key))


def numbered(df: DataFrame, order: list[Column], key: str = "cluster_id") -> DataFrame:
    """(key, position from 1) of every row in an order. Rows are sorted in ranges, and a range starts where the ranges before
    it end: no task sees them all."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(key, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    rows = written(ranged, "ranges")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "part").select(key, (F.col("before") + F.col("at") + 1).alias("position"))


def sample_members(members: DataFrame, n: int = 100) -> DataFrame:
    """At most ``n`` members of each cluster, the smallest ids."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("record_id"))
    return members.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def new_to_town(df: DataFrame, entity: str, place: str, ts: str, key: str) -> DataFrame:
    """``df`` with label: ``new to data`` at an entity's first row, ``new to town`` at its first in a place, else ``local``.

    First rows are minima, aggregated map-side, so an entity with very many rows is not sorted in one task.
    """
    at = F.struct(ts, key)
    first_here = df.groupBy(entity, place).agg(F.min(at).alias("here"))
    first = first_here.groupBy(entity).agg(F.min("here").alias("ever"))
    labels = first_here.join(first, entity)
    label = F.when(at == F.col("ever"), "new to data").when(at == F.col("here"), "new to town").otherwise("local")
    return df.join(labels, [entity, place]).withColumn("label", label).drop("here", "ever")


def union_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """All links of two tables, repeated ones kept."""
    return a.unionByName(b)


def shared_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that two results have in common, once each; nulls count as equal."""
    return a.intersect(b)


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids``; repeated rows and rows with a null key stay."""
    return df.join(ids.select(key), key, "left_anti")


def merge_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; the column names must be the same."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    return a.unionByName(b)


def merge_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], ring: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the first graph, with unseen nodes of the second (as ring 4) and its unseen edges."""
    new = b[0].join(a[0].select("id"), "id", "left_anti").withColumn("ring", F.lit(ring))
    edges = b[1].join(a[1].select("src", "dst"), ["src", "dst"], "left_anti")
    return a[0].unionByName(new), a[1].unionByName(edges)


def all_tags(tags: DataFrame) -> DataFrame:
    """Distinct tags, null as one of them if it occurs."""
    return tags.select("tag").distinct()
