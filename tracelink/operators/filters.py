"""Filters, searches and value cleaning. All predicates are column expressions, so they reach the scan; id
lists are semi joins, never literal lists.

Unless a function says otherwise: a null meets no condition except as the empty text of a text comparison, and null ids match nothing; repeated rows stay, repeated ids of a list count once;
rows keep their order and columns, also ones that are named like a function's own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.functions import text as fx

OPERATORS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}


def predicate(df: DataFrame, column: str, op: str, value) -> Column:
    """One comparison: numbers by value, texts without regard to case and null as ''. ``contains`` is for text."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.NumericType) and op != "contains":
        return F.coalesce(getattr(c, OPERATORS[op])(F.lit(value)), F.lit(False))
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.contains(low, F.lit(str(value).lower())) if op == "contains" else getattr(low, OPERATORS[op])(F.lit(str(value).lower()))


def conjunction(df: DataFrame, filters: list[tuple]) -> Column:
    """All conditions together; true where there are none."""
    return reduce(lambda a, b: a & b, (predicate(df, *f) for f in filters), F.lit(True))


def apply_filters(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """Rows that meet every (column, operator, value); all rows without a filter."""
    return df.where(conjunction(df, filters))


def match_criteria(df: DataFrame, criteria: list[tuple[str, str, str]]) -> DataFrame:
    """Rows that meet every (column, equals or contains, value): equals ignores case, contains does not; null never matches."""
    test = {"equals": lambda c, v: F.lower(c) == F.lit(v.lower()), "contains": lambda c, v: F.contains(c, F.lit(v))}
    return df.where(reduce(lambda a, b: a & b, (test[kind](F.col(c), v) for c, kind, v in criteria), F.lit(True)))


def filter_clusters(members: DataFrame, records: DataFrame, filters: list[tuple] = (), tags: DataFrame | None = None, wanted_tags: list[str] = (), least_size: int = 1, mode: str = "any") -> DataFrame:
    """(cluster_id, size) of the clusters that pass. ``any``: one member meets all filters; ``each``: every
    filter is met by some member. Of the wanted tags one member must have one. All rows of a cluster are
    aggregated map-side, none is collected."""
    rows = members.join(records, "record_id", "left")
    tests = [predicate(rows, *f) for f in filters]
    tests = [reduce(lambda a, b: a & b, tests)] if tests and mode == "any" else tests
    if wanted_tags:
        tagged = tags.where(F.col("tag").isin(list(wanted_tags))).select("record_id", F.lit(True).alias("tagged")).distinct()
        rows = rows.join(tagged, "record_id", "left")
        tests.append(F.coalesce("tagged", F.lit(False)))
    checks = [F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tests)]
    out = rows.groupBy("cluster_id").agg(F.count_distinct("record_id").alias("size"), *checks)
    passed = reduce(lambda a, b: a & b, (F.col(f"t{i}") for i in range(len(checks))), F.col("size") >= least_size)
    return out.where(passed).select("cluster_id", "size")


def select_with_enrichment(df: DataFrame, columns: list[str], extras: list[DataFrame], key: str = "id") -> DataFrame:
    """The columns of ``df`` and those of enrichment tables joined by key."""
    return reduce(lambda a, b: a.join(b, key), extras, df.select(key, *[c for c in columns if c != key]))


def rows_for_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``; repeated rows stay, repeated ids count once, null keys match nothing."""
    return df.join(ids.select(key), key, "left_semi")


def text_search(df: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """Rows in which every term is the start of a word of some column."""
    return df.where(fx.starts_any(fx.tokens(F.concat_ws(" ", *columns)), terms))


def search(records: DataFrame, identifiers: DataFrame, places: DataFrame, q: str) -> DataFrame:
    """record_id of what ``q`` finds: digits and ``()-`` as part of an identifier; the name of a place as part
    of the region; else, or if that finds nothing, the start of a word of the text."""
    if q and all(ch in "0123456789()- " for ch in q):
        key = "".join(ch for ch in q if ch.isdigit())
        return identifiers.where(F.contains("value", F.lit(key))).select("record_id").distinct()
    if not places.where(F.lower("name") == F.lit(q.lower())).isEmpty():
        found = records.where(F.contains(F.lower("region"), F.lit(q.lower()))).select("record_id")
        if not found.isEmpty():
            return found
    return text_search(records, ["text"], q.split()).select("record_id")


def lookup_identifiers(identifiers: DataFrame, values: DataFrame) -> DataFrame:
    """Identifiers whose value is one of the listed raw ones (as lower-case text, or as digits)."""
    raw = values.select(F.trim(F.lower("raw")).alias("value")).unionByName(values.select(fx.digits(F.col("raw")).alias("value"))).distinct()
    return identifiers.join(raw, "value", "left_semi")


def search_values(identifiers: DataFrame, kind: str, value: str, exact: bool = True) -> DataFrame:
    """Identifier rows of a kind whose value is, or contains, a text, case counting; null values are left out, repeated rows stay."""
    own = identifiers.where(F.col("attribute") == kind)
    return own.where(F.col("value") == value) if exact else own.where(F.contains("value", F.lit(value)))


def within_extent(df: DataFrame, left: float, right: float, bottom: float, top: float) -> DataFrame:
    """Rows inside a map extent; left > right crosses the date line."""
    lon = F.col("lon").between(left, right) if left <= right else (F.col("lon") >= left) | (F.col("lon") <= right)
    return df.where(F.col("lat").between(bottom, top) & lon)


def within_days(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included, as a range over the timestamp itself."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def clean_values(df: DataFrame, column: str, bad: DataFrame, key: str = "id") -> DataFrame:
    """(key, column, cleaned, changed): a comma-joined column without the listed values; the order is kept."""
    parts = df.select(key, F.posexplode(F.split(F.col(column), ",")).alias("pos", "v")).join(bad.select(F.lower("value").alias("b")).distinct(), F.lower(F.trim("v")) == F.col("b"), "left_anti")
    good = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]), ",").alias("cleaned"))
    return df.select(key, column).join(good, key, "left").withColumn("cleaned", F.when(F.col(column).isNotNull(), F.coalesce("cleaned", F.lit("")))).withColumn("changed", ~F.col("cleaned").eqNullSafe(F.col(column)))


def audit_values(values: DataFrame, column: str = "value", good: str = "^http", least: int = 3) -> DataFrame:
    """(value, count) of values of ``least`` characters that do not match ``good`` and occur more than once."""
    return values.where((F.length(column) >= least) & ~F.regexp_like(F.col(column), F.lit(good))).groupBy(column).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def rewrite(df: DataFrame, column: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """``column`` replaced by the first rule whose condition holds."""
    out = reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(rules), F.col(column))
    return df.withColumn(column, out)


def distinct_for_clusters(members: DataFrame, records: DataFrame, clusters: DataFrame, column: str, n: int = 100) -> DataFrame:
    """The first ``n`` distinct values of a column over the records of some clusters."""
    own = members.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return records.join(own.select("record_id"), "record_id", "left_semi").select(column).distinct().orderBy(column).limit(n)
