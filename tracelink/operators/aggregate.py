"""Volumes, profiles and distributions. Counts are aggregated in long form, map-side first; maps are built
only from ranked rows, so no row holds an unbounded map.

Unless a function says otherwise: null keys and places are a group of their own, null ids meet nothing in a join, rows without a value or time that a function ranks, bins or
compares by are left out; repeated rows count as often as they stand (records of clusters and values once); ties go to the smaller value or id;
an empty table gives no rows, or one row of nulls and zeros where the result is one row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import text as fx


def count_of(df: DataFrame, *keys, name: str = "count") -> DataFrame:
    """Rows per key, nulls as a key of their own; no rows for an empty table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def daily_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, count); rows without a time are not counted."""
    return count_of(df.where(F.col(ts).isNotNull()), F.to_date(ts).alias("day"))


def location_time_volume(df: DataFrame, order: str = "record_id") -> DataFrame:
    """(location, day, lat, lon, count) with the coordinates of the location's first row by ``order``."""
    return df.groupBy("location", F.to_date("ts").alias("day")).agg(F.min_by("lat", order).alias("lat"), F.min_by("lon", order).alias("lon"), F.count(F.lit(1)).alias("count"))


def location_volume(df: DataFrame, places: DataFrame, name: str = "region") -> DataFrame:
    """(name, lat, lon, count) per located place, largest first; what no place has is dropped."""
    return count_of(df, F.lower(name).alias("low")).join(places.withColumn("low", F.lower("name")), "low").select("name", "lat", "lon", "count").orderBy(F.desc("count"), "name")


def source_counts(df: DataFrame, sources: DataFrame | None = None, key: str = "source") -> DataFrame:
    """Rows per source, largest first, with its name if ``sources`` (key, name) is given."""
    out = count_of(df, key)
    return (out if sources is None else out.join(sources, key, "left")).orderBy(F.desc("count"), key)


def matches_per(members: DataFrame, located: DataFrame, *keys: str) -> DataFrame:
    """(location, keys, matches): located records of each cluster or attribute value."""
    return count_of(members.join(located.select("record_id", "location"), "record_id"), "location", *keys, name="matches")


def facet_counts(members: DataFrame, records: DataFrame, facets: list[str], keys: list[str]) -> DataFrame:
    """(keys, facet, value, count): distinct records; a null value counts as ``none``."""
    rows = members.join(records.select("record_id", *facets), "record_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in facets]))
    return rows.select(*keys, "record_id", pairs.alias("p")).select(*keys, "record_id", "p.*").groupBy(*keys, "facet", "value").agg(F.count_distinct("record_id").alias("count"))


def top_n(counts: DataFrame, keys: list[str], n: int, least: int = 0, cap: int = 200) -> DataFrame:
    """The ``n`` largest counts per key, ties by value; values shorter than ``least`` are dropped, long ones cut."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "value"))
    own = counts.where(F.length("value") >= least).withColumn("value", F.substring("value", 1, cap))
    return own.withColumn("rank", rank).where(F.col("rank") <= n)


def top_n_map(counts: DataFrame, keys: list[str], n: int, least: int = 2) -> DataFrame:
    """(keys, top): a map of at most ``n`` values to counts."""
    ranked = top_n(counts, keys, n, least).groupBy(*keys, "value").agg(F.sum("count").alias("count"))
    return ranked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("top"))


def profiles(members: DataFrame, records: DataFrame, facets: list[str], keys: list[str], n: int = 40, ts: str = "ts") -> DataFrame:
    """Profile per key (cluster or attribute value): record_count, latest day, facets (facet -> value -> count,
    ``n`` largest), series (day -> count, in days since 1970). A record counts once for each of its keys."""
    names, keys = keys, [f"key_{k}" for k in keys]  # a key may be called value, as facets' values are
    members = members.select("record_id", *[F.col(a).alias(b) for a, b in zip(names, keys, strict=True)])
    maps = top_n_map(facet_counts(members, records, facets, keys), [*keys, "facet"], n)
    by_facet = maps.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("facet", "top"))).alias("facets"))
    rows = members.select(*keys, "record_id").distinct().join(records.select("record_id", F.to_date(ts).alias("day")), "record_id")
    day = F.unix_date(F.coalesce("day", F.lit("1970-01-01").cast("date"))).cast("long")
    days = count_of(rows, *keys, day.alias("day")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("day", "count"))).alias("series"), F.sum("count").alias("record_count"), F.date_from_unix_date(F.max("day").cast("int")).alias("latest"))
    return days.join(by_facet, keys, "left").withColumnsRenamed(dict(zip(keys, names, strict=True)))


def cluster_names(counts: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """(cluster_id, name): the top value, ties to the smaller, of ``first``; of ``second`` instead, if that is seen more than twice or
    more often; without either the same for ``third``; else the id. The value ``none`` is no name."""
    best = counts.where("value <> 'none'").withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "facet").orderBy(F.desc("count"), "value"))).where("r = 1")
    wide = best.groupBy("cluster_id").agg(*[F.max(F.when(F.col("facet") == f, F.struct("value", "count"))).alias(a) for a, f in (("a", first), ("b", second), ("c", third))])
    second_wins = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b.count") > 2) | (F.col("b.count") > F.col("a.count")))
    name = F.when(second_wins, F.col("b.value")).otherwise(F.coalesce("a.value", "c.value", F.col("cluster_id").cast("string")))
    return counts.select("cluster_id").distinct().join(wide, "cluster_id", "left").select("cluster_id", F.coalesce(name, F.col("cluster_id").cast("string")).alias("name"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: number of values, the most and the least frequent one, ties to the smaller value."""
    counts = count_of(df.where(F.col(column).isNotNull()), F.col(column).alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("n_values"), F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("most"), F.min_by("value", F.struct("count", "value")).alias("least"))


def count_distribution(df: DataFrame, column: str) -> DataFrame:
    """(k, n): how many values occur k times; the text ``null`` is left out."""
    own = df.where(F.col(column).isNotNull() & (F.lower(F.col(column).cast("string")) != "null"))
    return count_of(count_of(own, column, name="k"), "k", name="n")


def top_values(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """The ``n`` most frequent values with their count, null among them, ties in order of the value."""
    return count_of(df, column).orderBy(F.desc("count"), column).limit(n)


def cluster_summary(members: DataFrame) -> DataFrame:
    """One row: number of clusters, smallest, largest and mean size."""
    return count_of(members, "cluster_id", name="size").agg(F.count(F.lit(1)).alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"), F.round(F.avg("size"), 6).alias("mean"))


def facet_summary(counts: DataFrame) -> DataFrame:
    """(facet, value, clusters): clusters whose profile has the lower-case value."""
    return counts.groupBy("facet", F.lower("value").alias("value")).agg(F.count_distinct("cluster_id").alias("clusters"))


def facet_totals(counts: DataFrame) -> DataFrame:
    """(cluster_id, facet, total, none, largest): the sums that a profile's bars are drawn from."""
    return counts.groupBy("cluster_id", "facet").agg(F.sum("count").alias("total"), F.sum(F.when(F.col("value") == "none", F.col("count")).otherwise(0)).alias("none"), F.max(F.when(F.col("value") != "none", F.col("count"))).alias("largest"))


def select_by_facet(profiles_: DataFrame, facet: str, value: str) -> DataFrame:
    """``profiles_`` with selected: whether its map of the facet has the value, without regard to case."""
    keys = F.coalesce(F.map_keys(F.element_at("facets", facet)), F.array().cast("array<string>"))
    return profiles_.withColumn("selected", F.exists(keys, lambda k: F.lower(k) == value.lower()))


def value_shares(df: DataFrame, column: str, deny: list[str] = ()) -> DataFrame:
    """(value, count, share): missing as ``none``, values with a denied part left out."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("none"))
    counts = count_of(df, value.alias("value"))
    counts = counts.where(~reduce(lambda a, d: a | F.contains("value", F.lit(d)), deny, F.lit(False)))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "count", F.round(F.col("count") / F.col("total"), 6).alias("share"))


def word_counts(df: DataFrame, whole: list[str], split: list[str], stop: DataFrame, n: int = 100, least: int = 3) -> DataFrame:
    """The ``n`` most frequent words: values of some columns as they are, words of others, stop words left out."""
    words = F.flatten(F.array(*[F.array(F.lower(F.col(c))) for c in whole], *[fx.tokens(F.col(c)) for c in split]))
    own = df.select(F.explode(words).alias("word")).where(F.length("word") >= least)
    return count_of(own, "word").join(stop.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").orderBy(F.desc("count"), "word").limit(n)


def merge_timeseries(profiles_: DataFrame) -> DataFrame:
    """(day, count) summed over the series of profiles."""
    return profiles_.select(F.explode("series").alias("day", "n")).groupBy("day").agg(F.sum("n").alias("count"))


def related_locations(cluster_locations: DataFrame, location, n: int = 20) -> DataFrame:
    """(location, clusters): other places of the clusters seen at a place, the ``n`` most shared."""
    own = cluster_locations.where(F.col("location") == location).select("cluster_id").distinct()
    others = cluster_locations.where(F.col("location") != location).join(own, "cluster_id", "left_semi")
    return others.groupBy("location").agg(F.count_distinct("cluster_id").alias("clusters")).orderBy(F.desc("clusters"), "location").limit(n)


def segment_series(series: DataFrame, location, segments: dict[int, str], measures: list[str]) -> DataFrame:
    """Daily pivot of a location: a column per segment and measure, missing as 0; days before 1970-01-02 dropped."""
    own = series.where((F.col("location") == location) & (F.col("day") > F.lit("1970-01-01").cast("date")))
    cells = [F.coalesce(F.sum(F.when(F.col("segment") == k, F.col(m))), F.lit(0)).alias(f"{name}_{m}") for k, name in segments.items() for m in measures]
    return own.groupBy("day").agg(*cells)


def period_change(volume: DataFrame, start: str, end: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per location: total and mean per day of a window, the trimmed mean of all days (ranks from ``low`` to
    ``high`` of them), their difference, ratio and sign."""
    order = Window.partitionBy("location").orderBy("count", "day")
    ranked = volume.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("location")))
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    kept = (F.col("r") > F.floor(F.col("n") * low)) & (F.col("r") <= F.greatest(F.ceil(F.col("n") * high), F.floor(F.col("n") * low) + 1))
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    out = ranked.groupBy("location").agg(F.coalesce(F.sum(F.when(inside, F.col("count"))), F.lit(0)).alias("total"), F.avg(F.when(kept, F.col("count"))).alias("usual"))
    mean = F.col("total") / days
    return out.select("location", "total", F.round(mean, 6).alias("mean"), F.round("usual", 6).alias("usual"), F.round(mean - F.col("usual"), 6).alias("delta"), F.round(mean / F.col("usual"), 6).alias("ratio"), F.signum(mean - F.col("usual")).cast("int").alias("sign"))


def time_histogram(df: DataFrame, ts: str, n: int = 7) -> DataFrame:
    """(bucket, count): ``n`` equal parts of the time range, empty ones too."""
    seconds = F.unix_timestamp(ts)
    low, high = df.agg(F.min(seconds), F.max(seconds)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bucket int, count long")
    bucket = F.least(F.lit(n - 1), F.floor((seconds - low) * n / max(1, high - low))).cast("int")
    counts = count_of(df.where(F.col(ts).isNotNull()), bucket.alias("bucket"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def minmax_scale(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``df`` with scaled: the column's place between its extremes; ``low`` when all are equal."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return df.join(F.broadcast(ends)).withColumn("scaled", F.round(low + share * (high - low), 6)).drop("lo", "hi")


def place_summary(df: DataFrame, least: float = 5.0, most: float = 25.0) -> DataFrame:
    """(location, lat, lon, count, first_id, scaled) of the places of a result, sizes scaled to a range."""
    own = df.groupBy("location").agg(F.min_by("lat", "record_id").alias("lat"), F.min_by("lon", "record_id").alias("lon"), F.count(F.lit(1)).alias("count"), F.min("record_id").alias("first_id"))
    return minmax_scale(own, "count", least, most)


def sample_values(members: DataFrame, records: DataFrame, column: str, n: int = 11) -> DataFrame:
    """(cluster_id, sample): up to ``n`` distinct values of a column per cluster, in order, comma-joined."""
    own = members.join(records.select("record_id", F.col(column).cast("string").alias("value")), "record_id").where("value IS NOT NULL").select("cluster_id", "value").distinct()
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("value"))
    return own.withColumn("r", rank).where(F.col("r") <= n).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("sample"))


def tag_counts(tags: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, tag, count): distinct records of a cluster with a tag."""
    return members.join(tags.select("record_id", "tag"), "record_id").groupBy("cluster_id", "tag").agg(F.count_distinct("record_id").alias("count"))


def largest_id(df: DataFrame, key: str) -> DataFrame:
    """The largest key, nulls aside (null for an empty table), and the number of rows."""
    return df.agg(F.max(key).alias("largest"), F.count(F.lit(1)).alias("rows"))


def count_containing(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """One row with the number of texts that contain each term, in one pass."""
    return df.agg(*[F.count_if(F.contains(F.col(column), F.lit(t))).alias(f"n_{i}") for i, t in enumerate(terms)])


def refine_column(df: DataFrame, column: str, method: str = "fingerprint", n: int = 2) -> DataFrame:
    """(value, key, refined): each spelling, its key by ``method`` (fingerprint, ngram, metaphone or phonetic), and the most frequent
    spelling with that key, ties to the first in order. Nulls are left out."""
    keys = {"fingerprint": fx.fingerprint_key, "ngram": lambda c: fx.ngram_key(c, n), "metaphone": fx.sound_key, "phonetic": fx.soundex_key}
    key = keys[method](F.col("value"))
    counts = count_of(df.where(F.col(column).isNotNull()), F.col(column).alias("value")).withColumn("key", key)
    best = counts.groupBy("key").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("refined"))
    return counts.join(best, "key").select("value", "key", "refined")


def suppress_conflicts(identifiers: DataFrame, matches: DataFrame, least: int = 5) -> DataFrame:
    """Identifiers without those that a measurement of the same record - digits of ``least`` or more - contains or
    is contained in. Both sides: (record_id, value)."""
    own = matches.where(F.length("value") >= least).select(F.col("record_id").alias("_r"), F.col("value").alias("_v"))
    return identifiers.join(own, (F.col("record_id") == F.col("_r")) & (F.contains("value", F.col("_v")) | F.contains(F.col("_v"), F.col("value"))), "left_anti")


def suppress_by_raw(identifiers: DataFrame, text: str, pattern: str) -> DataFrame:
    """Identifiers (record_id, value, text) without those whose digits stand, in the raw text, in a span that the
    price pattern matches."""
    spaced = F.regexp_replace("value", "([0-9])", "$1[^0-9a-zA-Z]*")
    span = F.coalesce(F.regexp_substr(F.col(text), F.concat(F.lit(".{0,2}"), spaced, F.lit(".{0,2}"))), F.lit(""))
    return identifiers.where(~F.regexp_like(span, F.lit(pattern)))


def build_identifiers(declared: DataFrame, extracted: DataFrame, suppressed: DataFrame, most_digits: int = 15) -> DataFrame:
    """(record_id, attribute, value): declared and extracted values, trimmed, longer than one character; phones
    as digits, at most ``most_digits``; without suppressed (attribute, value) rows."""
    both = declared.select("record_id", "attribute", "value").unionByName(extracted.select("record_id", "attribute", "value"))
    value = F.when(F.col("attribute") == "phone", fx.digits(F.col("value"))).otherwise(F.trim("value"))
    own = both.withColumn("value", value).where((F.length("value") > 1) & ((F.col("attribute") != "phone") | (F.length("value") <= most_digits))).distinct()
    return own.join(suppressed.select("attribute", "value"), ["attribute", "value"], "left_anti").select("record_id", "attribute", "value")
