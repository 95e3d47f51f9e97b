"""Streaming forms of volumes, first sights and incremental linking. Each equals its batch twin on the same rows.

State ends: a watermark closes day windows and drops what was not seen for long enough, so rows that come later than ``late`` are left
out, and an entity that was not seen for ``forget`` is new again. Rows without a time are left out. What a batch changes is added beside
what earlier batches wrote; no batch writes the whole result again, and a repeated batch writes its own part again.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelink.operators.updates import joined
from tracelink.session import remove


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def windowed_volume(stream: DataFrame, ts: str, keys: list[str] = (), late: str = "1 day") -> DataFrame:
    """(day, keys, count) over day windows with a watermark."""
    counts = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.to_date("window.start").alias("day"), *keys, "count")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> list[int]:
    """Process what is there now and stop. Each batch's rows are added under its number: new rows (``append``) or the new state
    of rows that changed (``update``, for ``read_latest``). Returns the rows of state after each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key's row of what ``run_available`` wrote in ``update`` mode."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def first_sights(stream: DataFrame, keys: list[str], ts: str, late: str = "31 days") -> DataFrame:
    """The first row seen of each key inside the watermark: new to the data by entity, new to town by entity and place."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def labels(stream: DataFrame, entity: str, place: str, ts: str, key: str, late: str = "1 day", forget: str = "400 days") -> DataFrame:
    """(key, label): each row as ``new to data`` (the first of its entity), ``new to town`` (the first of its entity at the place) or ``local``. Rows
    of a batch are taken in order of time and key, batches as they come. An entity is forgotten once the watermark is ``forget`` past its
    last row, and so is a place of it, which ends the state of both; rows later than ``late``, or without an entity or time, are left out."""
    life = pd.Timedelta(forget)
    kinds = dict(stream.dtypes)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("entity"), F.col(place).cast("string").alias("place"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col(key).alias(key))
    span = int(life.total_seconds() * 1000)

    def mark(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, names, times = state.get if state.exists else (None, [], [])
        seen = dict(zip(names, times, strict=True))
        parts = list(parts)
        own = parts[0] if len(parts) == 1 else pd.concat(parts)  # of one entity in one batch
        ids, at, places = (own[c].to_numpy() for c in (key, "at", "place"))
        order = own.reset_index(drop=True).sort_values(["at", key], kind="stable").index if ids.dtype == object else np.lexsort((ids, at))
        out = []
        for now, where in zip((at[order] // 1000).tolist(), places[order].tolist(), strict=True):
            if last is None or now - last > span:
                out.append("new to data")
                seen = {}
            else:
                out.append("local" if where in seen and now - seen[where] <= span else "new to town")
            last, seen[where] = max(now, last or now), max(now, seen.get(where, now))
        seen = {p: t for p, t in seen.items() if last - t <= span}
        state.update((last, list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: ids[order], "label": out})

    return rows.groupBy("entity").applyInPandasWithState(mark, f"{key} {kinds[key]}, label string", "last long, places array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def runs(count: int, fanout: int) -> list[tuple[int, int]]:
    """(first, size) of the runs that hold ``count`` versions: as few as there are digits of ``count`` to base ``fanout`` allow, larger ones first."""
    out, first, size = [], 0, 1
    while size * fanout <= count:
        size *= fanout
    while size:
        while first + size <= count:
            out.append((first, size))
            first += size
        size //= fanout
    return out


class Log:
    """A table that grows by a version for each batch: every ``fanout`` runs of one size are merged into one of the next, so a batch reads a number of runs
    that grows with the logarithm of the batches. A run is named by the versions that it holds; merging is repeated
    by a repeated batch, and the parts of a run are removed one batch later."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] = (), fanout: int = 4) -> None:
        self.spark, self.path, self.schema, self.keys, self.fanout = spark, path, schema, list(keys), fanout

    def at(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{run[0]}-{run[1]}"

    def there(self, run: tuple[int, int]) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at(run)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read_runs(self, found: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*map(self.at, found)) if found else self.spark.createDataFrame([], self.schema)

    def parts(self, run: tuple[int, int]) -> list[tuple[int, int]]:
        step = run[1] // self.fanout
        return [(run[0] + i * step, step) for i in range(self.fanout)] if step else []

    def merge(self, run: tuple[int, int]) -> None:
        """Write a run from its parts, and these from theirs, where it is not there yet."""
        parts = self.parts(run)
        if parts and not self.there(run):
            for part in parts:
                self.merge(part)
            rows = self.read_runs(parts)
            (rows.groupBy(*self.keys).agg(F.sum("n").alias("n")) if self.keys else rows).write.mode("overwrite").parquet(self.at(run))

    def clear(self, run: tuple[int, int]) -> None:
        """Remove the parts of a run, and of these the parts of the last, which was merged with it."""
        for part in self.parts(run):
            remove(self.spark, self.at(part))
        for part in self.parts(run)[-1:]:
            self.clear(part)

    def read(self, count: int) -> DataFrame:
        """What the first ``count`` versions wrote; runs that are complete by now are merged first. With ``keys``, n is summed for each."""
        for run in runs(count, self.fanout):
            if sum(run) == count:
                self.merge(run)
            elif sum(run) == count - 1:  # merged by the batch before
                self.clear(run)
        return self.read_runs(runs(count, self.fanout))

    def write(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.at((version, 1)))

    def versions(self) -> list[tuple[int, int]]:
        """The runs that hold all versions now."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found, out, first = sorted((tuple(map(int, n.split("-"))) for n in names), key=lambda r: (r[0], -r[1])), [], 0
        for run in found:
            if run[0] == first and self.there(run):
                out.append(run)
                first += run[1]
        return out


MEMBERS = "cluster_id long, record_id long"
HELD = "attribute string, value string, cluster_id long, n long"


def link_stream(stream: DataFrame, members_path: str, held_path: str, checkpoint: str, fanout: int = 4) -> None:
    """Incremental linking per micro-batch: new (record_id, attribute, value) rows join or open clusters, ids of later batches being
    larger. A batch adds its members, and how many of its records each cluster has with a value, as one version each of two ``Log`` tables; it reads
    what clusters hold of its own values. Rows of records that are linked already, or without a value, are left out."""

    def link(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        members, held = Log(spark, members_path, MEMBERS, fanout=fanout), Log(spark, held_path, HELD, ["attribute", "value", "cluster_id"], fanout)
        known, counts = members.read(number), held.read(number)
        rows = batch.select("record_id", "attribute", "value").where("value IS NOT NULL").distinct().join(known.select("record_id"), "record_id", "left_anti")
        new = joined(rows, counts)
        members.write(number, new)
        new = spark.read.schema(MEMBERS).parquet(members.at((number, 1)))
        held.write(number, rows.join(new, "record_id").groupBy("attribute", "value", "cluster_id").agg(F.count(F.lit(1)).alias("n")))

    stream.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """All members that ``link_stream`` wrote."""
    log = Log(spark, path, MEMBERS)
    return log.read_runs(log.versions())
