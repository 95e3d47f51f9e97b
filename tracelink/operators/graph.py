"""Graphs over clusters and values: components, rings, communities, indexes, place clusters.

Unless a function says otherwise: null nodes and values are in no link, repeated links and values count once, ties go to the smaller node, an empty table gives an
empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tracelink.operators.joins import cluster_links, with_lists
from tracelink.session import TASK_ROWS, dealt, shared_dir, written


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and all its partners. The minimum is pre-aggregated map-side,
    and the join back may be split where one node has very many partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _min_neighbour(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(near.select("u", F.col("m").alias("v")))


def _signature() -> list[Column]:
    return [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component in a graph of ``n`` nodes with links a[i] - b[i]: the larger root of each link is hung below the
    smaller one and paths are halved, until all links lie within a tree."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _rooted(links: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of links (u, v) in order, the place of each link's u and v among them, and the place of each node's smallest linked node."""
    ends = pa.chunked_array([*links.column("u").chunks, *links.column("v").chunks]).combine_chunks()
    coded = ends.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    codes = rank[np.asarray(coded.indices)]
    u, v = codes[: len(links)], codes[len(links) :]
    return coded.dictionary.take(order), u, v, roots(u, v, len(order))


def local_forests(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(u, v) of links (u, v): what each partition knows of its links' components, as one star of each around its smallest node, which stands with itself.
    At most one row for each node and partition, and fewer than the links have ends; a partition of more than ``most`` nodes gives stars of its parts.
    A task holds ``most`` links and a batch at once, however long its partition is, and gives memory back after each star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def stars() -> pa.RecordBatch:
            names, _, _, root = _rooted(pa.Table.from_batches(held))
            return pa.record_batch([names, names.take(pa.array(root))], names=["u", "v"])

        def contracted() -> pa.RecordBatch:
            found = stars()
            held.clear()
            pa.default_memory_pool().release_unused()
            return found

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > most:  # stars have a row for each node
                held.append(contracted())
                rows = 2 * held[0].num_rows if held[0].num_rows <= most // 2 else 0
                if not rows:
                    yield held.pop()
        if held:
            yield contracted()

    return links.select("u", "v").mapInArrow(run, links.select("u", "v").schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each partition first contracts its own links to stars, so what is shuffled grows with nodes, not links. Then large-star and
    small-star steps alternate until the edge set, by then a star around each smallest
    node, no longer changes; this takes a number of rounds that grows with the logarithm of the
    longest path. Each round is checkpointed to the shared folder. Links with a null end are
    dropped, a link of a node to itself keeps the node, repeated links count once, and an empty
    table gives an empty result.
    """
    shared_dir(edges.sparkSession)
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    links = local_forests(links).distinct().checkpoint()
    nodes = links.select("u").distinct()
    stars, before = links.where("u <> v"), None
    for _ in range(max_rounds):
        stars = _small_star(_large_star(stars)).distinct().checkpoint()
        now = stars.agg(*_signature()).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(stars, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _one_level(links: DataFrame, rows: int, most: int) -> DataFrame:
    """(u, v, link): of links (u, v) the smallest node v that a task knows to be linked with each u (link is false), and that of each v of the task
    (link is true). All links of a u are in one task, so only nodes that are some v are left in the latter. A task holds ``most`` links and a batch
    at once: links come in order of u, and a u with more than that is contracted as it comes."""

    def told(part: pa.Table) -> Iterator[pa.RecordBatch]:
        names, u, v, root = _rooted(part)
        for codes, link in ((u, False), (v, True)):
            own = np.unique(codes)
            yield pa.record_batch([names.take(pa.array(own)), names.take(pa.array(root[own])), pa.array(np.full(len(own), link))], names=["u", "v", "link"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n <= most:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            u = part.column("u")
            if start := pc.index(u, u[-1]).as_py():
                yield from told(part.slice(0, start))
                held = part.slice(start).combine_chunks().to_batches()
            else:  # one u alone: it goes on with the smallest node it has met
                star, met = told(part)
                yield met
                held = [star.select(["u", "v"])]
            n = sum(b.num_rows for b in held)
            pa.default_memory_pool().release_unused()
        if held:
            yield from told(pa.Table.from_batches(held))

    own = dealt(links.select("u", "v"), rows, "u").sortWithinPartitions("u")
    return own.mapInArrow(run, StructType([*own.schema, StructField("link", BooleanType())]))


def components_by_levels(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(node, component) of links (u, v) without nulls, where v is at most u and every v has a link to itself; the component is the smallest node.

    A level deals links out by u, once: tasks contract them, note what each u is linked with, and pass on links between the v alone. So a level
    costs one shuffle of its links, where a round of stars costs about eight. Levels go on while links are many and nodes become fewer by a third at least; star rounds
    do the rest, so long paths take no more rounds than there."""
    rows = written(local_forests(links, most), "level-links")
    n, levels, before = rows.count(), [], None
    while True:
        level = written(_one_level(rows, n, most), "levels")
        levels.append(level.where("NOT link").select("u", F.col("v").alias("root")))
        rows = level.where("link").select("u", "v")
        found = {r.link: r["count"] for r in level.groupBy("link").count().collect()}
        n, nodes = found.get(True, 0), found.get(False, 0)
        if n <= TASK_ROWS or (before and nodes > before * 2 / 3):
            break
        before = nodes
    out = connected_components(rows, "u", "v")
    for level in reversed(levels):
        out = level.join(out.withColumnRenamed("node", "root"), "root").select(F.col("u").alias("node"), "component")
    return out


def component_sizes(components: DataFrame) -> DataFrame:
    """(size, components): how many components have each size."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def expand_rings(seeds: DataFrame, links: DataFrame, rings: int, cap: int | None = None) -> DataFrame:
    """(node, ring): nodes within ``rings`` - 1 undirected steps of the seeds, with the first ring they appear in.

    ``seeds`` has node, ``links`` src and dst. No step starts once there are more than ``cap`` nodes, and
    of the last ring the smallest ids up to ``cap`` stay. Each ring is one join with what is new.
    """
    shared_dir(seeds.sparkSession)
    both = links.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(links.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    seen = seeds.select("node").distinct().withColumn("ring", F.lit(0)).checkpoint()
    for ring in range(1, rings):
        n = seen.count()
        if cap is not None and n >= cap:
            break
        new = both.join(seen.where(F.col("ring") == ring - 1).select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if cap is not None:
            new = new.orderBy("node").limit(cap - n)
        grown = seen.unionByName(new.withColumn("ring", F.lit(ring))).checkpoint()
        if grown.count() == n:
            break
        seen = grown
    return seen


def expand_rings_by_values(seeds: DataFrame, values: DataFrame, rings: int, cap: int | None = None) -> DataFrame:
    """``expand_rings`` over clusters that share a value, through ``values`` (cluster_id, attribute, value): a step goes to the new
    nodes' values and from these to their clusters, so it costs rows, not links, however many clusters share a value. Values are computed and
    written once, repeated rows as they come; what a step has met is a table of known size, so a small one is broadcast instead of values being shuffled."""
    own = written(values.where("value IS NOT NULL").select(F.col("cluster_id").alias("node"), "attribute", "value"), "ring-values")
    seen = written(seeds.select("node").distinct().withColumn("ring", F.lit(0)), "seen")
    used = None
    for ring in range(1, rings):
        n = seen.count()
        if cap is not None and n >= cap:
            break
        met = own.join(seen.where(F.col("ring") == ring - 1).select("node"), "node", "left_semi").select("attribute", "value").distinct()
        if used is not None:  # what an earlier ring has led to is seen
            met = met.join(used, ["attribute", "value"], "left_anti")
        met = written(met, "met-values")
        used = met if used is None else used.unionByName(met)
        new = own.join(met, ["attribute", "value"], "left_semi").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        if cap is not None:
            new = new.orderBy("node").limit(cap - n)
        new = written(new.withColumn("ring", F.lit(ring)), "seen")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def _among(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(src, dst, reason): links, the other end the smaller, between given nodes through equal values."""
    own = values.select("cluster_id", "attribute", "value").distinct().join(nodes.select(F.col("node").alias("cluster_id")), "cluster_id", "left_semi")
    return cluster_links(own).select(F.col("cluster_id").alias("src"), F.col("other_id").alias("dst"), F.col("value").alias("reason"))


def link_reasons(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(src, dst, reasons): links between shown nodes with all shared values, in order, comma-joined. The values of shown nodes
    alone are joined, so links are bounded by the nodes shown."""
    return _among(nodes, values).groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def search_graph(hits: DataFrame, members: DataFrame, values: DataFrame, max_nodes: int = 400, max_links: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, matches) and edges (src, dst) of a search: the clusters of its hits - the ``max_nodes`` with most
    matches - and at most ``max_links`` links of each through shared values, smallest ids first. Only the nodes' values are joined."""
    nodes = members.join(hits.select("record_id").distinct(), "record_id").groupBy(F.col("cluster_id").alias("node")).agg(F.count_distinct("record_id").alias("matches")).orderBy(F.desc("matches"), "node").limit(max_nodes)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    pairs = _among(nodes, values).select("src", "dst").distinct()
    return nodes, pairs.withColumn("r", rank).where(F.col("r") <= max_links).drop("r")


def _nearest(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task says of its points (lat, lon, n): for each centre the weighted sums of the points that are nearest to it, ties to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2, len(centres))), np.zeros(len(centres), np.int64)
        for batch in batches:
            lat, lon, n = (np.asarray(batch.column(c)) for c in ("lat", "lon", "n"))
            near = ((lat[:, None] - centres[:, 0]) ** 2 + (lon[:, None] - centres[:, 1]) ** 2).argmin(axis=1)
            for axis, values in enumerate((lat, lon)):
                sums[axis] += np.bincount(near, values * n, len(centres))
            np.add.at(counts, near, n)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at]), pa.array(counts[at])], names=["i", "lat", "lon", "n"])

    return run


def geo_kmeans(df: DataFrame, k: int = 100, max_rounds: int = 100) -> DataFrame:
    """(lat, lon, count) of clusters of points (lat, lon), weighted by ``count`` if there is one: squared-degree distance, starting
    from a grid over the extent, until no centre moves. The ``k`` centres are all that the driver holds. Points are grouped and written once; a round
    reads them and adds up each centre's own as arrays, so it compiles nothing."""
    points = df.groupBy("lat", "lon").agg((F.sum("count") if "count" in df.columns else F.count(F.lit(1))).alias("n")).where("lat IS NOT NULL AND lon IS NOT NULL")
    points = written(points.select(F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("n").cast("long")).where("n IS NOT NULL"), "points")
    lo_lat, hi_lat, lo_lon, hi_lon = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if lo_lat is None:
        return points.select("lat", "lon", F.col("n").alias("count"))
    side = max(1, round(k**0.5))
    centres = [(lo_lat + (hi_lat - lo_lat) * (i + 0.5) / side, lo_lon + (hi_lon - lo_lon) * (j + 0.5) / side) for i in range(side) for j in range(side)]
    for _ in range(max_rounds):
        sums = points.mapInArrow(_nearest(np.array(centres)), "i int, lat double, lon double, n long")
        means = sums.groupBy("i").agg((F.sum("lat") / F.sum("n")).alias("lat"), (F.sum("lon") / F.sum("n")).alias("lon"), F.sum("n").alias("count")).collect()
        moved = sorted((round(r.lat, 9), round(r.lon, 9), r["count"]) for r in means)  # empty clusters drop out
        now = [(a, b) for a, b, _ in moved]
        if now == centres:
            break
        centres = now
    else:
        raise RuntimeError(f"centres still move after {max_rounds} rounds")
    return df.sparkSession.createDataFrame([(float(a), float(b), int(n)) for a, b, n in moved], "lat double, lon double, count long")


def communities(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(node, community, settled) by label propagation on (src, dst, weight): in each round a node takes the label with the most
    weight among itself and its neighbours, ties to the smallest. It ends when nothing changes or, as labels may change for ever,
    after ``max_rounds`` rounds; ``settled`` is false where the last round still changed the label. Links of a node to itself
    and links with a null end are left out, repeated links add up."""
    shared_dir(edges.sparkSession)
    links = edges.where("src <> dst")
    both = links.select("src", "dst", "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")).checkpoint()
    labels = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community"), F.lit(False).alias("settled")).checkpoint()
    for _ in range(max_rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        votes = votes.unionByName(labels.select(F.col("node").alias("src"), "community", F.lit(0.5).alias("w"))).groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        labels = best.join(labels.select("node", F.col("community").alias("before")), "node").select("node", "community", (F.col("community") == F.col("before")).alias("settled")).checkpoint()
        if labels.where("NOT settled").isEmpty():
            break
    return labels


def communities_by_values(values: DataFrame, max_rounds: int = 20) -> DataFrame:
    """``communities`` of nodes (node, attribute, value) that are linked by shared values, a link's weight being their number, without forming links.

    A round counts the labels at each value and adds these counts up at the value's nodes, less the node's own share. What a node gets
    from a value is one packed list, so rows that are shuffled grow with rows; the counts are as many as values have labels, times
    their nodes: the number of links in the first round at most, and fewer as labels spread. A round's shuffle files end with it. Nodes
    without a shared value keep their own label. Null nodes and values are left out and repeated rows count once."""
    keys = ["attribute", "value"]
    own = written(values.where("node IS NOT NULL AND value IS NOT NULL").select("node", *keys).distinct(), "voters")
    shared = written(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared-values")
    linked = written(own.join(shared.select(keys), keys), "linked-voters")
    pairs = shared.agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0
    labels = written(linked.groupBy("node").agg(F.count(F.lit(1)).alias("own")).select("node", F.col("node").alias("community"), "own", F.lit(False).alias("settled")), "labels")
    for _ in range(max_rounds):
        here = linked.join(labels.select("node", "community", "own"), "node")
        at_value = here.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("n"))
        met = with_lists(here, at_value, keys, "community", "n", pairs, ["node"])
        votes = met.select("node", "community", "own", "ns", F.posexplode("others").alias("at", "new")).select("node", "community", "own", "new", F.col("ns")[F.col("at")].alias("n"))
        less = F.when(F.col("new") == F.first("community"), F.lit(0.5) - F.first("own")).otherwise(F.lit(0.0))  # a node stands at each of its values itself
        best = votes.groupBy("node", "new").agg((F.sum("n").cast("double") + less).alias("w"), F.first("community").alias("community"), F.first("own").alias("own"))
        best = best.groupBy("node").agg(F.min_by("new", F.struct(-F.col("w"), F.col("new"))).alias("new"), F.first("community").alias("community"), F.first("own").alias("own"))
        labels = written(best.select("node", F.col("new").alias("community"), "own", (F.col("new") == F.col("community")).alias("settled")), "labels")
        if labels.where("NOT settled").isEmpty():
            break
    alone = own.select("node").distinct().join(labels.select("node"), "node", "left_anti")
    return labels.select("node", "community", "settled").unionByName(alone.select("node", F.col("node").alias("community"), F.lit(True).alias("settled")))


def cluster_values(members: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(cluster_id, attribute, value, count): distinct records of a cluster with a value; grouping by either side gives
    the index in that direction."""
    own = members.join(identifiers, "record_id").select("cluster_id", "attribute", "value", "record_id")
    return dealt(own, identifiers.count(), "cluster_id", "value").groupBy("cluster_id", "attribute", "value").agg(F.count_distinct("record_id").alias("count"))


def attribute_ids(identifiers: DataFrame) -> DataFrame:
    """(attribute_id, attribute, value): every distinct value numbered from 1 in order of attribute and value. Values
    are sorted in ranges, and a range starts where the ranges before it end: no task sees them all."""
    ranged = identifiers.select("attribute", "value").distinct().repartitionByRange("attribute", "value").sortWithinPartitions("attribute", "value")
    parts = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(before, "part").select((F.col("before") + F.col("at") + 1).alias("attribute_id"), "attribute", "value")
