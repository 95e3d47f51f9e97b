"""Exact top-k by integer inner product with M-trees.

Largest inner product becomes smallest distance by one more coordinate: with M at least the largest
squared norm, a candidate x is placed at (x, sqrt(M - |x|^2)) and a query q at (q, 0), so that the squared
distance is |q|^2 + M - 2 <q, x>. Candidates are dealt to the nearest of a bounded number of sampled pivots; each
cell (split evenly where it has more than ``tree_rows`` rows) is bulk-loaded once into an M-tree of paged nodes,
which goes to a file of the shared folder. An entry holds its pivot, covering radius and distance to the parent's
pivot.

Queries - a stated set of rows - are first searched in the tree of their own cell, which gives each a score
that its result cannot fall below. Then blocks of queries pass the other trees: a block and a tree meet in
a task that reads both from their files, so neither trees nor vectors are shuffled again. A search takes the page
with the best bound first, for all queries of the block that it is still open to; entries that the stored
distances put out of reach (|d(q, parent) - d(pivot, parent)| - radius) take no part in the matrix product that
computes the others' distances. Bounds carry a margin for rounding; scores are exact integers.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; vectors of
different lengths are compared as if the shorter ended in zeros; equal scores rank by smaller vec_id;
of rows with the same vec_id each is a candidate of its own, but never one of a query with that id,
and the results of a query id that occurs with several vectors are merged; a null vec_id takes no part;
a table whose largest squared norm is 2^63 or more has scores that no long holds and raises ValueError;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.llm.common import filesystem, unique_name
from tracelink.session import work_path, written

#: Entries of a page.
PAGE = 64
#: Integers up to this size are exact as doubles, and so are sums of products whose norms stay below it.
EXACT = 1 << 53
FOUND = "query_id long, vec_id long, score long"


class Node:
    """A page: its entries' points and distances to the page's pivot; for an inner page radii and children, for a leaf ids."""

    __slots__ = ("children", "ids", "norms", "parent", "points", "radii")

    def __init__(self, points: np.ndarray, norms: np.ndarray, parent: np.ndarray, radii=None, children=None, ids=None) -> None:
        self.points, self.norms, self.parent, self.radii, self.children, self.ids = points, norms, parent, radii, children, ids


class MTree:
    """A bulk-loaded M-tree over integer vectors (rows of ``x``) with ids.

    ``computed`` counts the distances and scores that searches computed.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: int, seed: int = 0) -> None:
        self.largest, self.computed, self.size = largest, 0, len(ids)
        self.margin = 1e-6 * (1 + np.sqrt(float(largest)))
        x = x.astype(np.float64) if largest < EXACT else x
        last = np.sqrt(np.maximum(0.0, float(largest) - (x.astype(np.float64) ** 2).sum(axis=1)))
        rng = np.random.default_rng(seed)
        self.root = self._load(ids, x, last, None, rng) if len(ids) else None

    def _distances(self, x, last, pivot) -> np.ndarray:
        """Distances of (x, last) to a pivot given as (vector, last coordinate); 0 where there is none."""
        if pivot is None:
            return np.zeros(len(x))
        return np.sqrt(((x - pivot[0]) ** 2).sum(axis=1) + (last - pivot[1]) ** 2)

    def _load(self, ids, x, last, pivot, rng) -> Node:
        """A page around ``pivot``; rows go to the nearest of PAGE sampled pivots, and are split evenly where
        distance cannot tell them apart."""
        if len(ids) <= PAGE:
            order = np.argsort(ids, kind="stable")
            x, last = x[order], last[order]
            return Node(x, (x.astype(np.float64) ** 2).sum(axis=1) + last**2, self._distances(x, last, pivot), ids=ids[order])
        real = x.astype(np.float64)
        count = min(PAGE, -(-len(ids) // (PAGE // 2)))
        chosen = np.sort(rng.choice(len(ids), count, replace=False))
        pivots, tops = real[chosen], last[chosen]
        half = ((pivots**2).sum(axis=1) + tops**2) / 2
        nearest = np.empty(len(ids), np.int64)
        for lo in range(0, len(ids), 65_536):
            part = slice(lo, lo + 65_536)
            nearest[part] = (real[part] @ pivots.T + last[part, None] * tops - half).argmax(axis=1)
        parts = [(rows, (pivots[j], tops[j])) for j in range(count) if len(rows := np.flatnonzero(nearest == j))]
        if max(len(rows) for rows, _ in parts) > 0.9 * len(ids):  # mostly equal points: cut in order of id
            order = np.array_split(np.argsort(ids, kind="stable"), min(PAGE, -(-len(ids) // PAGE)))
            parts = [(rows, (real[rows].mean(axis=0), last[rows].mean())) for rows in order]
        points = np.array([c[0] for _, c in parts])
        tops = np.array([c[1] for _, c in parts])
        radii = np.array([self._distances(real[rows], last[rows], c).max() for rows, c in parts])
        children = [self._load(ids[rows], x[rows], last[rows], c, rng) for rows, c in parts]
        return Node(points, (points**2).sum(axis=1) + tops**2, self._distances(points, tops, pivot), radii, children)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, id and score of what may be among each query's ``k`` best: its best k in this tree, without
        candidates of its own id and those below its score in ``least``."""
        count = len(own)
        none = -np.inf if self.largest < EXACT else -np.iinfo(np.int64).max
        scores = np.full((count, k), none)
        ids = np.full((count, k), np.iinfo(np.int64).max)
        filled = np.zeros(count, np.int64)
        floor = np.full(count, -np.inf) if least is None else least.astype(np.float64)
        q = q.astype(np.float64) if self.largest < EXACT else q
        real = q.astype(np.float64)
        square = (real**2).sum(axis=1)
        base = square + float(self.largest)

        def reach(rows: np.ndarray) -> np.ndarray:
            """Distance beyond which nothing can enter a query's result."""
            worst = np.where(filled[rows] >= k, np.maximum(scores[rows, -1].astype(np.float64), floor[rows]), floor[rows])
            return np.sqrt(np.maximum(0.0, base[rows] - 2 * worst)) + self.margin

        def leaf(rows: np.ndarray, node: Node, near: np.ndarray) -> None:
            entries = np.flatnonzero(near.any(axis=0))
            self.computed += len(rows) * len(entries)
            found = q[rows] @ node.points[entries].T
            held = np.where(filled[rows] >= k, scores[rows, -1], none)
            able = (found >= held[:, None]) & (found >= floor[rows, None]) & (node.ids[entries] != own[rows, None])
            some = able.any(axis=1)
            if not some.any():
                return
            rows, found, able = rows[some], found[some], able[some]
            both = np.hstack([scores[rows], np.where(able, found, none)])
            names = np.hstack([ids[rows], np.where(able, node.ids[entries], np.iinfo(np.int64).max)])
            order = np.lexsort((names, -both), axis=1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
            filled[rows] = np.minimum(k, filled[rows] + able.sum(axis=1))

        everyone = np.arange(count)
        pages = [(0.0, 0, self.root, everyone, np.zeros(count), None)] if self.root and count else []
        serial = 0
        while pages:
            _, _, node, rows, low, to_pivot = heapq.heappop(pages)
            limit = reach(rows)
            open_ = low <= limit
            rows, limit = rows[open_], limit[open_]
            if not len(rows):
                continue
            near = np.ones((len(rows), len(node.points)), bool)
            if to_pivot is not None:
                to_pivot = to_pivot[open_]
                far = np.abs(to_pivot[:, None] - node.parent)
                near = (far if node.radii is None else far - node.radii) <= limit[:, None]
                some = near.any(axis=1)
                rows, limit, near = rows[some], limit[some], near[some]
                if not len(rows):
                    continue
            if node.radii is None:
                leaf(rows, node, near)
                continue
            entries = np.flatnonzero(near.any(axis=0))
            self.computed += len(rows) * len(entries)
            d = np.sqrt(np.maximum(0.0, square[rows, None] + node.norms[entries] - 2 * (real[rows] @ node.points[entries].T)))
            low = np.maximum(0.0, d - node.radii[entries])
            near = near[:, entries] & (low <= limit[:, None])
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                some = near[:, j]
                serial += 1
                heapq.heappush(pages, (float(low[some, j].min()), serial, node.children[entries[j]], rows[some], low[some, j], d[some, j]))
        at, place = np.nonzero(ids < np.iinfo(np.int64).max)
        return at, ids[at, place], scores[at, place].astype(np.int64)


def vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the vector with each component x as floor(scale * x), of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(whole, F.lit(False))).withColumns({"vec_id": F.col("vec_id").cast("long"), "v": F.transform(x, lambda c: F.floor(c.cast("double") * scale))})


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, short ones padded with 0."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.int64, copy=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def in_cells(own: DataFrame, pivots: np.ndarray, width: int, largest: int) -> DataFrame:
    """``own`` (vec_id, v, is_query) with cell, the nearest pivot to the row as a candidate, and home, the nearest to it as a query."""
    last = np.sqrt(np.maximum(0.0, float(largest) - (pivots.astype(np.float64) ** 2).sum(axis=1)))
    shared = own.sparkSession.sparkContext.broadcast((pivots.astype(np.float64), last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, tops = shared.value
        half = ((points**2).sum(axis=1) + tops**2) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), width).astype(np.float64)
            near = x @ points.T - half
            top = np.sqrt(np.maximum(0.0, float(largest) - (x**2).sum(axis=1)))
            cells = [pa.array(a.argmax(axis=1).astype(np.int32)) for a in (near + top[:, None] * tops, near)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, "cell", "home"])

    return own.mapInArrow(run, "vec_id long, v array<long>, is_query boolean, cell int, home int")


def _save(directory: str, kind: str, value) -> str:
    store, to = filesystem(directory)
    store.create_dir(to, recursive=True)
    name = unique_name(kind, ".bin")
    with store.open_output_stream(f"{to}/{name}", compression=None) as out:
        out.write(pickle.dumps(value, protocol=5))
    return name


def _load(directory: str, name: str):
    store, to = filesystem(directory)
    with store.open_input_stream(f"{to}/{name}", compression=None) as f:
        return pickle.loads(f.read())  # a file that a task of this job wrote


def _found(own: np.ndarray, result: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    at, ids, scores = result
    return pa.table([pa.array(own[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, tree_rows: int = 20_000, block: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest inner products.

    About ``tree_rows`` candidates make one tree and about ``block`` queries one block; a task holds one of each.
    ``most_pivots`` bounds the sample that rows are dealt by, which decides speed only.
    """
    spark = df.sparkSession
    own = written(vectors(df, scale).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, width, largest = own.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if largest >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit a long")
    width, largest = max(1, width), int(largest) + 1
    trees = max(1, -(-n // tree_rows), min(spark.sparkContext.defaultParallelism, n // 2000))
    sample = own.select("v").distinct().orderBy(F.xxhash64("v")).limit(min(trees, most_pivots)).toArrow()
    directory = work_path(spark, "m-trees")
    rows = written(in_cells(own, matrix(sample.column("v").combine_chunks(), width), width, largest), "cells")

    # trees, each built once
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / tree_rows).cast("int").alias("subs"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        tree = MTree(np.asarray(group.column("vec_id")), matrix(group.column("v").combine_chunks(), width), largest)
        return pa.table({"cell": group.column("cell")[:1].combine_chunks(), "sub": group.column("sub")[:1].combine_chunks(), "subs": group.column("subs")[:1].combine_chunks(), "tree": [_save(directory, "tree", tree)]})

    built = written(dealt.select("cell", "sub", "subs", "vec_id", "v").repartition(trees, "cell", "sub").groupBy("cell", "sub").applyInArrow(build, "cell int, sub int, subs int, tree string"), "trees")

    # a floor for each query from the tree of its cell
    queries = rows.where("is_query").select("vec_id", "v", "home").distinct()
    at_home = queries.join(F.broadcast(sizes.withColumnRenamed("cell", "home")), "home").withColumn("sub", F.pmod(F.xxhash64("v", "vec_id"), F.col("subs")).cast("int"))
    at_home = written(at_home.join(built.select(F.col("cell").alias("home"), "sub", "tree"), ["home", "sub"]).select("vec_id", "v", "home", "tree"), "asked")
    parts = at_home.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    at_home = at_home.join(parts, "tree").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))

    def first(group: pa.Table) -> pa.Table:
        ids, x = np.asarray(group.column("vec_id")), matrix(group.column("v").combine_chunks(), width)
        at, found, scores = _load(directory, group.column("tree")[0].as_py()).search(ids, x, k)
        ends = np.searchsorted(at, np.arange(len(ids) + 1))
        # just below the k-th score, as the double may be rounded up
        floor = [np.nextafter(float(scores[b - 1]), -np.inf) if b - a >= k else -np.inf for a, b in zip(ends, ends[1:], strict=False)]
        hits = pa.StructArray.from_arrays([pa.array(found), pa.array(scores)], ["vec_id", "score"])
        return pa.table([*(group.column(c) for c in ("vec_id", "v", "home", "tree")), pa.array(floor, pa.float64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)], names=["vec_id", "v", "home", "tree", "floor", "hits"])

    answered = written(at_home.groupBy("tree", "part").applyInArrow(first, "vec_id long, v array<long>, home int, tree string, floor double, hits array<struct<vec_id: long, score: long>>"), "answered")

    # blocks of queries that are near each other
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                value = (np.asarray(part.column("vec_id")), matrix(part.column("v"), width), np.asarray(part.column("floor")), np.array(part.column("tree").to_pylist()))
                yield pa.record_batch([pa.array([_save(directory, "queries", value)])], names=["file"])

    asked = answered.count()
    blocks = max(1, -(-asked // block))
    near = answered.select("vec_id", "v", "home", "floor", "tree").repartitionByRange(blocks, "home", "vec_id").sortWithinPartitions("home", "vec_id")
    stored = written(near.mapInArrow(store, "file string"), "blocks")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, None
        for batch in batches:
            for t, file in zip(batch.column("tree").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if t != name:
                    name, tree = t, _load(directory, t)
                ids, x, floor, home = _load(directory, file)
                other = home != t
                yield from _found(ids[other], tree.search(ids[other], x[other], k, floor[other])).to_batches()

    # every tree meets every block, as file names, 64 blocks to a key; a task takes the meetings of one tree one after the other
    keys = -(-blocks // 64)
    stored = stored.withColumn("key", F.pmod(F.xxhash64("file"), F.lit(keys)))
    meetings = built.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))).alias("key")).join(stored, "key").select("tree", "file")
    tasks = max(1, min(trees * blocks, 64 * spark.sparkContext.defaultParallelism))
    others = meetings.repartition(tasks, "tree", "file").sortWithinPartitions("tree").mapInArrow(rest, FOUND)
    found = answered.select(F.col("vec_id").alias("query_id"), F.explode("hits").alias("h")).select("query_id", "h.vec_id", "h.score").unionByName(others)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query among all vectors; queries are the rows whose id is divisible by 50."""
    out = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


OP5_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
