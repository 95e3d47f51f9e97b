"""Hard negatives by a secondary sort of pair scores.

Anchors - a stated set of rows - meet all rows in blocks: a task multiplies a block of anchors with a block of rows, both
read from files of the shared folder. Each pair score becomes one packed key of bytes, (anchor, descending score, kind, id), whose byte
order is the order wanted. The keys are dealt by anchor and sorted within their partitions (the DataFrame form of
repartitionAndSortWithinPartitions), and an iterator reads each partition as a stream: a positive opens a window of scores,
a negative goes to the open windows that it fits, a full window closes. It holds the windows of one anchor, never an anchor's rows.

Two streams keep what is shuffled small, and lose nothing. The first has of each block the best same-label rows of each
anchor and gives the anchor's positives; the second has these and, of each block, the best rows of each window. A row that is
among the first k of all rows is among the first k of its block.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of different
lengths are compared as if the shorter ended in zeros; equal scores go by smaller id; repeated rows are candidates each, a repeated
anchor row counts once; rows with an anchor's id are never its positives or negatives, and anchor rows that share an id
but not vector and label are anchors of their own; an anchor without positives gives no rows; a table whose largest
squared norm is 2^63 or more raises ValueError; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import load, save
from tracelink.llm.topk import EXACT, matrix, vectors
from tracelink.session import work_path, written

#: A packed key. Signed numbers have their top bit turned, descending ones all bits.
KEY = np.dtype([("anchor", ">u8"), ("tag", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
TOP = np.uint64(1 << 63)
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NONE = np.iinfo(np.int64).min


def pack(anchor: np.ndarray, tag: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys of pairs as a binary column."""
    keys = np.empty(len(ids), KEY)
    keys["anchor"], keys["tag"] = anchor.astype(np.int64).view(np.uint64) ^ TOP, tag.astype(np.int64).view(np.uint64)
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ TOP)
    keys["kind"], keys["id"] = kind, ids.astype(np.int64).view(np.uint64) ^ TOP
    ends = np.arange(len(ids) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def unpack(column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, tag, score, kind, id) of each key."""
    keys = np.frombuffer(b"".join(column.to_pylist()), KEY)
    signed = lambda a: (a.astype(np.uint64) ^ TOP).view(np.int64).tolist()
    score = signed(~keys["score"].astype(np.uint64))
    return zip(signed(keys["anchor"]), keys["tag"].astype(np.uint64).view(np.int64).tolist(), score, keys["kind"].tolist(), signed(keys["id"]), strict=True)


def in_order(keys: DataFrame) -> DataFrame:
    """Keys dealt by anchor and sorted within their partitions."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def first_positives(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """The first ``count`` positives of each anchor in a sorted stream."""
    anchor, left = None, 0
    for batch in batches:
        out = []
        for a, t, score, kind, i in unpack(batch.column("key")):
            if (a, t) != anchor:
                anchor, left = (a, t), count
            if left and kind == POSITIVE:
                left -= 1
                out.append((a, t, score, i))
        yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=["anchor_id", "tag", "score", "positive_id"])


def mined(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``MINED`` from a sorted stream of an anchor's positives and negatives."""
    anchor, left = None, 0
    open_: list[list[int]] = []  # positive_id, its score, least score, largest score, negatives so far
    for batch in batches:
        out = []
        for a, t, score, kind, i in unpack(batch.column("key")):
            if (a, t) != anchor:
                anchor, left, open_ = (a, t), positives, []
            if kind == POSITIVE:
                if left:
                    left -= 1
                    open_.append([i, score, *window(score, low, high), 0])
                continue
            open_ = [w for w in open_ if w[4] < negatives and w[2] <= score]  # scores only fall from here
            for w in open_:
                if score <= w[3]:
                    w[4] += 1
                    out.append((a, w[0], w[4], i, w[1], score))
        yield pa.record_batch([pa.array(x, pa.int32() if n == 2 else pa.int64()) for n, x in enumerate(zip(*out, strict=True) if out else [[]] * 6)], names=[c.split()[0] for c in MINED.split(", ")])


class Block:
    """Rows by ascending id: ids, labels and vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]


class Anchors(Block):
    """Anchors with the tags that tell those of one id apart and, for the second stream, the scores of their positives."""

    def __init__(self, ids, labels, x, tags: np.ndarray, scores: list[list[int]]) -> None:
        super().__init__(ids, labels, x)
        order = np.argsort(ids, kind="stable")
        self.tags, self.scores = tags[order], [scores[i] for i in order]


def scored(anchors: Anchors, block: Block, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor the block's rows by descending score and id, their scores, and whether they may be positives (1), negatives (0)
    or neither (-1)."""
    a, b = (x.astype(np.float64) if exact else x for x in (anchors.x, block.x))
    scores = (a @ b.T).astype(np.int64)
    order = np.argsort(-scores, axis=1, kind="stable")
    kinds = np.where(anchors.ids[:, None] == block.ids, -1, (anchors.labels[:, None] == block.labels).astype(np.int8))
    return order, np.take_along_axis(scores, order, axis=1), np.take_along_axis(kinds, order, axis=1)


def best_positives(anchors: Anchors, block: Block, exact: bool, count: int) -> pa.Array:
    """Keys of each anchor's best ``count`` same-label rows of a block."""
    order, scores, kinds = scored(anchors, block, exact)
    able = kinds == 1
    row, at = np.nonzero(able & (np.cumsum(able, axis=1) <= count))
    return pack(anchors.ids[row], anchors.tags[row], scores[row, at], POSITIVE, block.ids[order[row, at]])


def best_negatives(anchors: Anchors, block: Block, exact: bool, count: int, low: int, high: int) -> pa.Array:
    """Keys of the best ``count`` rows of a block in each window of each anchor."""
    order, scores, kinds = scored(anchors, block, exact)
    rows, ats = [], []
    for r, own in enumerate(anchors.scores):
        able = np.flatnonzero(kinds[r] == 0)
        down = -scores[r, able]
        taken = [np.zeros(0, np.int64)]
        for s in set(own):
            least, largest = window(s, low, high)
            if least <= largest:
                begin = np.searchsorted(down, -largest, "left")
                taken.append(able[begin : min(begin + count, np.searchsorted(down, -least, "right"))])
        at = np.unique(np.concatenate(taken))
        rows.append(np.full(len(at), r)), ats.append(at)
    row, at = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *ats])
    return pack(anchors.ids[row], anchors.tags[row], scores[row, at], NEGATIVE, block.ids[order[row, at]])


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, rows: int = 4096, anchors: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor of (vec_id, embedding, label) and each of
    its first ``positives`` same-label rows the first ``negatives`` other-label rows whose score is ``low`` to ``high`` percent
    of the positive's. ``high`` is at most 100, so that a window opens before its negatives come. ``rows`` and ``anchors`` are the sizes of blocks, which decide speed and memory only."""
    if high > 100:
        raise ValueError("windows end at the positive's score")
    spark = df.sparkSession
    label = F.col("label").cast("long")
    own = vectors(df.where("label IS NOT NULL"), scale).select("vec_id", "v", label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    own = written(own, "labelled")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, width, largest, asked = own.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm), F.count_if("is_anchor")).first()
    if not n or not asked:
        return spark.createDataFrame([], MINED)
    if largest >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit a long")
    width, exact = max(1, width), largest < EXACT / 2
    directory = work_path(spark, "pairs")

    def store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                value = Block(np.asarray(part.column("vec_id")), np.asarray(part.column("label")), matrix(part.column("v"), width))
                yield pa.record_batch([pa.array([save(directory, "rows", value)])], names=["file"])

    def store_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, anchors):
                part = batch.slice(lo, anchors)
                value = Anchors(np.asarray(part.column("vec_id")), np.asarray(part.column("label")), matrix(part.column("v"), width), np.asarray(part.column("tag")), [s or [] for s in part.column("scores").to_pylist()])
                yield pa.record_batch([pa.array([save(directory, "anchors", value)])], names=["file"])

    parts = max(1, -(-n // rows))
    stored = written(own.select("vec_id", "label", "v").repartition(parts).mapInArrow(store_rows, "file string"), "row-blocks")
    tagged = written(own.where("is_anchor").select("vec_id", "label", "v").distinct().withColumn("tag", F.xxhash64("v", "label")), "anchors")
    blocks = max(1, -(-asked // anchors))

    def keys(asking: DataFrame, make) -> DataFrame:
        """Keys of all meetings of blocks of anchors with blocks of rows; a block of rows is read once for the anchors of a task."""
        files = written(asking.repartition(blocks).mapInArrow(store_anchors, "file string"), "anchor-blocks").select(F.col("file").alias("asking"), F.pmod(F.xxhash64("file"), F.lit(-(-blocks // 64))).alias("key"))
        meet = stored.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-blocks // 64) - 1).cast("long"))).alias("key")).join(files, "key").select("file", "asking")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, block = None, None
            for batch in batches:
                for file, ask in zip(batch.column("file").to_pylist(), batch.column("asking").to_pylist(), strict=True):
                    if file != name:
                        name, block = file, load(directory, file)
                    yield pa.record_batch([make(load(directory, ask), block)], names=["key"])

        tasks = max(1, min(parts * blocks, 64 * spark.sparkContext.defaultParallelism))
        return meet.repartition(tasks, "file", "asking").sortWithinPartitions("file").mapInArrow(run, "key binary")

    found = in_order(keys(tagged.withColumn("scores", F.array().cast("array<long>")), lambda a, b: best_positives(a, b, exact, positives)))
    found = written(found.mapInArrow(lambda batches: first_positives(batches, positives), "anchor_id long, tag long, score long, positive_id long"), "positives")
    windows = found.groupBy(F.col("anchor_id").alias("vec_id"), "tag").agg(F.collect_list("score").alias("scores"))
    both = keys(tagged.join(windows, ["vec_id", "tag"]), lambda a, b: best_negatives(a, b, exact, negatives, low, high))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(batch.column(c)) for c in ("anchor_id", "tag", "score", "positive_id")]
            yield pa.record_batch([pack(*x[:3], POSITIVE, x[3])], names=["key"])

    both = in_order(both.unionByName(found.mapInArrow(again, "key binary")))
    return both.mapInArrow(lambda batches: mined(batches, positives, negatives, low, high), MINED)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; every seventh row's label is moved on by one."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
     s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
                        FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
     n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
