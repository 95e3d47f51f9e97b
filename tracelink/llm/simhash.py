"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at most ``distance`` bits and the
segments' radii r satisfy sum(r + 1) > distance, some segment differs in at most its r bits. So each
fingerprint enters one table per segment under the segment's value, and looks up all values in the Hamming
ball of radius r around it; what it meets there is verified on all 64 bits. Of the two
fingerprints of a pair only the one with a 0 at the lowest differing bit looks the other up.

Documents with equal fingerprints are one node. Inside a bucket of up to ``SMALL`` fingerprints every pair is
verified; in a larger one a breadth-first search that removes what it has reached gives a spanning
forest, so a group of near copies yields links in proportion to its size, not to its square. A bucket of
more than ``hot_rows`` entries and look-ups is split: few own entries are copied to each block of look-ups, many are dealt
out in pairs of blocks.

Edge cases: a null or blank text has fingerprint 0, linked like any other; a text with fewer words than a
shingle is one shingle; rows with the same doc_id are rows of their own; a component whose
doc_ids are all null has a null component_id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.llm.common import release, sized, small_batches, texts_of
from tracelink.operators.graph import connected_components
from tracelink.session import written

SEED = 42
SMALL = 64
#: Values of a sketch, and of each of its bands: of two texts at 0.8 a band agrees with a chance of 0.33, one of all 20 with 0.9996.
SKETCH, BAND = 100, 5
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, SKETCH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, in order, repeats included; fewer words are one shingle."""
    words = text.lower().split()  # of bytes: only A-Z change, and only ASCII blanks split
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    width = min(width, len(words))
    begin, end = starts[: len(words) - width + 1].tolist(), (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], "<u8")


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's shingles of ``width`` words, repeats included."""
    return folded(shingle_hashes(text, width))


def folded(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``docs`` with fp, the fingerprint of the text as a signed long, in place of any column of this name."""
    base = docs.drop("fp")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                fps = np.fromiter((fingerprint(x.as_py(), width) for x in texts_of(part, "text").cast(pa.large_binary())), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], names=[*part.schema.names, "fp"])

    return base.mapInArrow(mark, T.StructType([*base.schema.fields, T.StructField("fp", T.LongType())]))


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment; radii are the smallest that miss no pair, the last ones smaller."""
    sizes = [64 // count + (i >= count - 64 % count) for i in range(count)]
    slots = [(distance + 1) // count + (i < (distance + 1) % count) for i in range(count)]
    return [(sum(sizes[:i]), sizes[i], slots[i] - 1) for i in range(count)]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of the lowest ``bits`` bits, 0 first."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def bucket_rows(distinct: DataFrame, count: int, distance: int) -> DataFrame:
    """bucket, probe (0: the table's own entry, 1: a look-up) and fp: all entries of all tables."""
    parts = []
    for i, (shift, bits, radius) in enumerate(segments(count, distance)):
        value = f"(shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L)"
        if radius < 0:
            continue
        masks = ", ".join(f"{m}L" for m in ball(bits, radius))
        # a mask is looked up where its lowest bit is 0 in the value
        parts.append(f"transform(filter(array({masks}), m -> {value} & (m & -m) = 0), m -> struct(shiftleft({i}L, 58) | ({value} ^ m) AS bucket, cast(m <> 0 AS int) AS probe))")
    return distinct.select("fp", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("e")).select("e.bucket", "e.probe", "fp")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``distance`` of each other step by step: at most len(fps) - 1 of them."""
    left, a, b = fps, [], []
    while len(left):
        reached, left = [left[:1]], left[1:]
        while reached and len(left):
            for x in reached.pop():
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found, left = left[near], left[~near]
                    a.append(np.full(len(found), x)), b.append(found)
                    reached.append(found)
                    if not len(left):
                        break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, distance: int = 4, count: int = 3, hot_rows: int = 20_000) -> DataFrame:
    """src and dst: pairs of fingerprints at most ``distance`` apart, with the same components as all such pairs."""
    rows = bucket_rows(distinct, count, distance)
    hot = rows.groupBy("bucket").agg(F.count_if(F.col("probe") == 0).alias("own"), F.count(F.lit(1)).alias("count")).where((F.col("own") > 0) & (F.col("count") > hot_rows))
    keys = ["bucket"]
    if not hot.isEmpty():
        n = F.ceil(F.coalesce("count", F.lit(1)) / hot_rows).cast("int")
        rows = rows.join(hot, "bucket", "left").withColumn("n", n).withColumn("at", F.pmod(F.xxhash64("fp"), F.col("n")))
        # few own entries go to every block of look-ups; many are dealt out in pairs of blocks, as their look-ups are
        few = "IF(probe = 0, sequence(0L, n - 1L), array(at))"
        many = "transform(sequence(0L, n - 1L), x -> least(at, x) * n + greatest(at, x))"
        rows = rows.withColumn("pair", F.explode(F.expr(f"IF(coalesce(own, 0) <= {hot_rows}, {few}, {many})"))).select("bucket", "pair", "probe", "fp")
        keys.append("pair")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last bucket seen, which may go on in the next batch

        def pairs(own: list[np.ndarray]) -> pa.RecordBatch:
            fps, probe = own[-1].view(np.uint64), own[-2]
            change = np.any([np.diff(k) != 0 for k in own[:-2]], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(fps)]])
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL) & (probe[starts[:-1]] == 0), sizes))
            out = []
            for step in range(1, SMALL):
                small = small[(small + step < len(fps))]
                small = small[(group[small + step] == group[small]) & (probe[small] == 0)]
                if not len(small):
                    break
                hit = small[np.bitwise_count(fps[small] ^ fps[small + step]) <= distance]
                out.append((fps[hit], fps[hit + step]))
            out += [forest(np.unique(fps[starts[g] : starts[g + 1]]), distance) for g in np.flatnonzero((sizes > SMALL) & (probe[starts[:-1]] == 0))]
            none = np.zeros(0, np.uint64)
            a, b = (np.concatenate([none, *(x[i] for x in out)]).view(np.int64) for i in (0, 1))
            return pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own = [np.concatenate([h, c]) for h, c in zip(held, own, strict=True)] if held else own
            last = np.all([k == k[-1] for k in own[:-2]], axis=0)
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = [c[cut:] for c in own]
            if cut:
                yield pairs([c[:cut] for c in own])
        if held:
            yield pairs(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "probe").mapInArrow(meet, "src long, dst long")


def components(marked: DataFrame, distance: int = 4, count: int = 3, hot_rows: int = 20_000) -> DataFrame:
    """(fp, root, component_id) of every distinct fp of ``marked`` (doc_id, fp): the component's smallest
    fingerprint and smallest doc_id."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected_components(links(distinct.select("fp"), distance, count, hot_rows))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, count: int = 3, hot_rows: int = 20_000) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    marked = written(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), width).select("doc_id", "fp"), "fingerprints")
    own = components(marked, distance, count, hot_rows).select("fp", "component_id")
    return marked.join(own, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest of each of ``SKETCH`` mixes of the hashes, as 32 bits."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (((hashes[i : i + 2048, None] ^ _MIX[0]) * _MIX[1]) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype("<u4")


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with fp and its sketch as bytes (null for a text without words)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                fps, sketches = np.zeros(part.num_rows, np.uint64), []
                for i, x in enumerate(texts_of(part, "text").cast(pa.large_binary())):
                    hashes = shingle_hashes(x.as_py(), width)
                    fps[i] = folded(hashes)
                    sketches.append(sketch(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64)), pa.array(sketches, pa.binary())], names=[*part.schema.names, "fp", "sketch"])
        release()

    return docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType())]))


def bands(nodes: DataFrame) -> DataFrame:
    """(band, fp, root) of nodes (fp, root, sketch): a row for each band of a sketch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("sketch").to_pylist()
            size, count = 4 * BAND, SKETCH // BAND
            keys = np.array([xxhash.xxh64_intdigest(x[i * size : (i + 1) * size], i) for x in own for i in range(count)], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(keys), *(pa.array(np.repeat(np.asarray(batch.column(c)), count)) for c in ("fp", "root"))], names=["band", "fp", "root"])

    return nodes.mapInArrow(cut, "band long, fp long, root long")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of fps that share a band and have other roots. A band's rows meet its leader, not each other, so pairs grow
    with rows; the leader is the one that meets most others in all its bands, which in a group of copies is the text that they come from."""
    rows = bands(nodes)
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("met"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "met")
    rows = written(rows.join(shared, "band"), "bands")
    weight = rows.groupBy("fp").agg(F.sum("met").alias("weight"))
    leader = rows.join(weight, "fp").groupBy("band").agg(F.max_by(F.struct(F.col("fp").alias("a"), F.col("root").alias("other")), F.struct("weight", -F.col("fp"))).alias("l")).select("band", "l.*")
    return rows.join(leader, "band").where("root <> other").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def resembling(marked: DataFrame, own: DataFrame, width: int, least: float = 0.8, slack: float = 0.2) -> DataFrame:
    """(src, dst): roots of fps (``own``: fp, root) one of whose texts shares ``least`` of the distinct shingles of both with the other's. ``marked`` has fp,
    text and sketch. Candidates share a band; those whose sketches agree in less than ``least`` - ``slack`` are left out (by
    chance one in 10,000 of the pairs at ``least``), all others are compared by their whole texts."""
    nodes = marked.where("sketch IS NOT NULL").groupBy("fp").agg(F.min("sketch").alias("sketch")).join(own.select("fp", "root"), "fp")
    nodes = written(nodes, "sketches")
    side = lambda df, c, x: df.select(F.col("fp").alias(c), F.col(x).alias(f"{x}_{c}"))
    pairs = candidates(nodes).join(side(nodes, "a", "sketch"), "a").join(side(nodes, "b", "sketch"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least - slack))

    pairs = written(pairs.mapInArrow(agree, "a long, b long"), "agreeing")
    asked = few(written(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "asked"))
    texts = written(marked.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "compared", compression="zstd")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text_a"):
                keep = []
                for x, y in zip(*(texts_of(part, c).cast(pa.large_binary()).to_pylist() for c in ("text_a", "text_b")), strict=True):
                    x, y = (np.unique(shingle_hashes(t, width)) for t in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    near = pairs.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
    with small_batches(marked.sparkSession, 500):
        near = written(near.mapInArrow(compare, "a long, b long"), "resembling")
    roots = own.select("fp", "root")
    return near.join(roots.select(F.col("fp").alias("a"), F.col("root").alias("src")), "a").join(roots.select(F.col("fp").alias("b"), F.col("root").alias("dst")), "b").select("src", "dst")


def few(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``keys`` (one long, written), to be broadcast if they are at most ``most``: else texts would be shuffled to meet a few numbers."""
    return F.broadcast(keys) if keys.count() <= most else keys


def first_of_each(docs: DataFrame, width: int = 5, distance: int = 6, count: int = 4, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies, all columns kept whatever their names: of the rows with the group's smallest doc_id (null, if
    none has one) that with the smallest hash of its text. For tables whose doc_ids repeat or are missing as well.

    Groups are the SimHash components, joined where texts of two share ``least`` of their shingles (``resembling``): fingerprints of
    texts at 0.8 differ in about 10 bits, which no table of this size finds."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, 500):
        marked = sketched(packed, width).withColumns({"text_hash": F.xxhash64("text"), "row_hash": F.xxhash64("row"), "row_no": F.monotonically_increasing_id()})
        marked = written(marked.drop("text"), "fingerprinted", compression="zstd")  # the text is in the row
    own = written(components(marked.select("doc_id", "fp"), distance, count), "simhash-components")
    joined = connected_components(resembling(marked.withColumn("text", F.col("row.text")), own, width, least)).select(F.col("node").alias("root"), "component")
    own = own.join(joined, "root", "left").select("fp", F.coalesce("component", "root").alias("root"), "component_id")
    smallest = own.groupBy("root").agg(F.min("component_id").alias("component_id"))
    rows = marked.select("doc_id", "fp", "text_hash", "row_hash", "row_no").join(own.select("fp", "root"), "fp").join(smallest, "root").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = written(rows.groupBy("root").agg(F.min_by("row_no", F.struct("text_hash", "row_hash", "row_no")).alias("row_no")).select("row_no"), "kept")
    return marked.select("row", "row_no").join(few(kept), "row_no", "left_semi").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
