"""Session defaults and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one task takes of what ``dealt`` deals out.
TASK_ROWS = 500_000
#: Paths made by ``work_path``.
_made: list[str] = []


def get_session(name: str = "tracelink", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests) a temporary folder is made once per session.
    The same folder serves ``DataFrame.checkpoint``.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; ``clear_work`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Delete the paths that this process made under the shared folder, once no result that reads them is needed any more; returns
    how many. Results are read lazily from these tables, so only the caller knows when."""
    gone = 0
    while _made:
        remove(spark, _made.pop())
        gone += 1
    return gone


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: lineage ends here, and so do the shuffle files of the write."""
    return written_to(df, work_path(df.sparkSession, name), **options)


#: Folders that a task writes to at once; rows need not be sorted by folder, which spills, unless a task has rows for more.
_WRITERS, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "64"


def written_to(df: DataFrame, path: str, mode: str = "error", by: list[str] = (), **options: str) -> DataFrame:
    """``written`` at a given path, for tables that are removed before the session ends."""
    spark = df.sparkSession
    wanted = {_CLEANUP: "true"} | ({_WRITERS: WRITERS} if by else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.mode(mode).options(**options).partitionBy(*by).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its ``rows`` take, and to the session's shuffle partitions at least: the memory of a task
    that groups or joins by these keys, or by more, does not grow with the table. A constant is no use as a key: Spark then deals out once more."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, 0 where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put a folder in place of another through Spark's file system; where there is no new one, only the old one goes."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(old)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if fs.exists(source) and not fs.rename(source, target):
        raise OSError(f"{new} was not put in place of {old}")
