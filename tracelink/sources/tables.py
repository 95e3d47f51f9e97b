"""Readers, sinks, published snapshots and listings. Rows are written as they are, nulls and repeated ones too; an empty table is written and
read as one, but not published."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.session import remove


def read_table(spark: SparkSession, source: str, id_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A partitioned scan: Parquet by path, or a table over JDBC (``jdbc:`` url with a dbtable option) in ranges of an
    id. The bounds only deal the ranges out over Parquet's filter or JDBC's partitions; they filter Parquet rows."""
    if source.startswith("jdbc:"):
        ranges = {"partitionColumn": id_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)} if bounds else {}
        return spark.read.format("jdbc").options(url=source, **ranges, **options).load()
    df = spark.read.parquet(source)
    return df.where(F.col(id_column).between(*bounds)) if bounds else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted fields and doubled quotes; rows of another width than the header are dropped."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "DROPMALFORMED").csv(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\x01", null: str = "\\N") -> DataFrame:
    """Typed records of delimited text without a header."""
    return spark.read.schema(schema).option("sep", sep).option("nullValue", null).csv(path)


def copy_table(df: DataFrame, target: str) -> None:
    """Append the rows to a Parquet table."""
    df.write.mode("append").parquet(target)


def save_result(df: DataFrame, target: str, partition_by: list[str] = ()) -> None:
    """Replace a result table, or of a partitioned one the partitions that ``df`` has rows for."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)


def _store(spark: SparkSession, path: str):
    """File system and path of a URI, through Spark."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text unless there is one; of several that try at once exactly one succeeds. On local disks a finished file is
    linked to its name, as creation there is not atomic; other stores create without overwriting."""
    store, at = _store(spark, path)
    store.mkdirs(at.getParent())
    own = at if store.getScheme() != "file" else at.suffix(f".{uuid.uuid4().hex}")
    try:
        out = store.create(own, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    if own is at:
        return True
    files = spark.sparkContext._jvm.java.nio.file.Files
    name = lambda p: spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).toPath()
    try:
        files.createLink(name(at), name(own))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        store.delete(own, False)


def publish_snapshot(spark: SparkSession, staged: DataFrame, root: str, name: str, ts: str = "mod_ts") -> bool:
    """Publish ``staged`` as the active version of a table if its newest row is newer than that of the active one; returns whether it was.

    Every attempt writes a folder of its own. A version is committed by a log entry under its number, which only one publisher can put;
    the others look again and try the next number, if their rows are still the newer ones. Readers follow the last entry, so
    they see one version whole. An empty table and one without times are not published."""
    newest = staged.agg(F.max(ts)).first()[0]
    if newest is None:
        return False
    at = f"{root}/{name}/{uuid.uuid4().hex}"
    written = False
    while True:
        active = active_version(spark, root, name)
        if active is not None and active["newest"] >= newest.isoformat():
            if written:
                remove(spark, at)
            return False
        if not written:
            staged.write.parquet(at)
            written = True
        version = 0 if active is None else active["version"] + 1
        entry = {"version": version, "newest": newest.isoformat(), "at": at.removeprefix(f"{root}/")}
        if put_if_absent(spark, f"{root}/_log/{name}/{version:020}.json", json.dumps(entry)):
            return True


def active_version(spark: SparkSession, root: str, name: str) -> dict | None:
    """The last complete log entry (version, newest, at) of a table, or None."""
    store, at = _store(spark, f"{root}/_log/{name}")
    if not store.exists(at):
        return None
    names = sorted((s.getPath() for s in store.listStatus(at) if s.getPath().getName().endswith(".json")), key=lambda p: p.getName(), reverse=True)
    for path in names:
        stream = store.open(path)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("}"):  # else its publisher still writes it
            return json.loads(text)
    return None


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The active version of a published table; an unknown table raises LookupError."""
    active = active_version(spark, root, name)
    if active is None:
        raise LookupError(f"{name} was never published under {root}")
    return spark.read.parquet(f"{root}/{active['at']}")


#: Bytes of pixels that an image sheet is closed at.
SHEET_BYTES = 1 << 20


def render_sheets(df: DataFrame, key: str, column: str, path: str, width: int = 16) -> int:
    """Write each row's bytes as a colour picture (three bytes to a pixel, rows of ``width`` pixels filled up with 0), pictures of a task one below another in
    image files (BMP) of about ``SHEET_BYTES``, so files grow with bytes, not with rows; returns how many pictures. Above each picture stand pixel rows
    that say its rows (8 bytes) and its key (2 bytes of length, text). Rows with a null key or null or empty bytes are left out."""
    filled = lambda data: data + bytes(-len(data) % (3 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, to = fs.FileSystem.from_uri(path)
        store.create_dir(to, recursive=True)
        part, sheets, held = TaskContext.get().partitionId(), 0, bytearray()

        def close() -> None:
            nonlocal sheets
            pixels = np.frombuffer(held, np.uint8).reshape(-1, width, 3)[::-1, :, ::-1]  # BMP: from the bottom, blue first
            rows = np.zeros((len(pixels), -(-3 * width // 4) * 4), np.uint8)
            rows[:, : 3 * width] = pixels.reshape(len(pixels), -1)
            head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, len(rows), 1, 24, 0, rows.size, 2835, 2835, 0, 0)
            with store.open_output_stream(f"{to}/{part}-{sheets}.bmp") as out:
                out.write(head + rows.tobytes())
            sheets += 1

        for batch in batches:
            for name, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                label, picture = name.encode(), filled(data)
                held += filled(struct.pack("<QH", len(picture) // (3 * width), len(label)) + label) + picture
                if len(held) >= SHEET_BYTES:
                    close()
                    held = bytearray()
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])
        if held:
            close()

    own = df.select(F.col(key).cast("string").alias("key"), F.col(column).cast("binary").alias("data")).where("key IS NOT NULL AND length(data) > 0")
    return own.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def load_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reference data from CSV: texts trimmed, blank or ``null`` or unreadable numbers as 0."""
    raw = read_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    return clean_dimension(raw, schema)


def clean_dimension(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the schema's types: numbers that cannot be read become 0, texts are trimmed."""
    out = []
    for f in schema:
        c = F.trim(F.col(f.name).cast("string"))
        if isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c.try_cast(f.dataType.simpleString()), F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return raw.select(*out)


def ensure_lexicon(spark: SparkSession, table: str, rows: DataFrame, path: str | None = None) -> DataFrame:
    """The lexicon table (keyword, class), seeded with the distinct ``rows`` if there is none, in the warehouse or at a path. Rows without a keyword are left out."""
    if not spark.catalog.tableExists(table):
        writer = rows.select("keyword", "class").where("keyword IS NOT NULL").distinct().write
        (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return spark.table(table)


def describe_datasets(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(dataset, column, type) of the tables under a folder."""
    rows = [(n, f.name, f.dataType.simpleString()) for n in names for f in spark.read.parquet(f"{root}/{n}.parquet").schema]
    return spark.createDataFrame(rows, "dataset string, column string, type string")


def datasets_with_sets(spark: SparkSession, root: str, names: list[str], sets: DataFrame) -> DataFrame:
    """(dataset, columns, rows, set_id, members) of the tables under a folder, a row per cluster set (set_id, dataset) of each, nulls where a dataset has none."""
    size = lambda n: spark.read.parquet(f"{root}/{n}.parquet").agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("rows"))
    columns = describe_datasets(spark, root, names).groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"))
    held = sets.groupBy("dataset", "set_id").agg(F.count(F.lit(1)).alias("members"))
    return columns.join(reduce(DataFrame.unionByName, map(size, names)), "dataset").join(held, "dataset", "left").select("dataset", "columns", "rows", "set_id", "members")


def profiles_to_json(profiles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, json): a profile's row as a JSON object, maps as objects."""
    return profiles.select(key, F.to_json(F.struct(*profiles.columns)).alias("json"))
