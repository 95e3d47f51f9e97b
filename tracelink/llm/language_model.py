"""Language-model scores by deleted interpolation.

P(w | u, v) mixes the maximum-likelihood estimates of the n-grams that end in w, from the longest to the single word and an even share
of all words: P_k = l_k f_k + (1 - l_k) P_(k-1), P_0 = 1 / (V + 1). The weight l_k depends on how often the context was seen, in
buckets of powers of two; it is 0 for contexts never seen. Weights are learned by expectation-maximisation on the tokens of one fold
of the training documents, with the fold's own counts taken off all counts (deleted), so these tokens are held out; half a token of
prior weight keeps every weight inside (0, 1). Scores then use the counts of all training documents.

Counting follows the tokens, whatever they are. Documents are read into chunks of about ``CHUNK`` bytes; a chunk's distinct words, and
later its distinct n-grams, are sorted by hash and cut into blocks, one to a bucket of hashes; the blocks of a bucket meet in one task, which adds
up counts and answers every block in the block's own order. An item that is everywhere comes once from each chunk, so no bucket is hot,
and the number of buckets grows with the items. The answers go back to their chunks, which then know all counts of their tokens.

Words are exact and get dense ids; longer n-grams are known by 64-bit hashes of their ids, so two of n are taken for one
with a chance of about n^2 / 2^65 in all.

Edge cases: null texts are empty, and an empty text is one end token; rows with a null doc_id are scored, and are training rows
only if the given condition says so; repeated rows count and are scored each; without training documents every word has
probability 1 / (V + 1) = 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import release, sized, small_batches, texts_of, words
from tracelink.session import remove, work_path, written, written_to

APART = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The end of a text as a word; no word holds white space.
END = b"\n"
#: Bytes of text in a chunk.
CHUNK = 4 << 20
#: Items of a bucket, about.
BUCKET = 700_000
CHUNKS = "chunk long, doc_id array<long>, train array<boolean>, fold array<boolean>, sizes array<int>, codes binary, words array<binary>, n binary, h binary"
CODED = "chunk long, doc_id array<long>, train array<boolean>, fold array<boolean>, sizes array<int>, codes binary, ids binary, c binary, h binary"
JOINED = "doc_id array<long>, train array<boolean>, fold array<boolean>, sizes array<int>, counts array<binary>, held array<binary>"
ANSWERS = "chunk long, bucket int, ids binary, c binary, h binary, types long, tokens long, held long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
BUCKETS = 64


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed bytes: least width, byte by byte."""
    most = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w))
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return width.to_bytes(1, "little") + len(a).to_bytes(7, "little") + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    """The integers of ``pack``, as long (unsigned where they need it)."""
    width, n = data[0], int.from_bytes(data[1:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], width * n), np.uint8)
    out = np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel()
    return out if width == 8 else out.astype(np.int64)


def counts_of(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: pa.Array) -> np.ndarray:
    """A 64-bit hash of each non-empty word, for dealing words to buckets."""
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    if not len(found):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(found.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(mix(place.astype(np.uint64) * np.uint64(256) + data), starts) + sizes.astype(np.uint64))


def chunk_row(ids: list, train: list, fold: list, texts: list) -> pa.RecordBatch:
    """A row of ``CHUNKS``: the tokens of some documents as codes of the chunk's words, which are sorted by hash."""
    ids, train, fold = (pa.concat_arrays(x) for x in (ids, train, fold))
    texts = pa.concat_arrays(texts)
    found, starts = words(texts, APART)
    coded = found.dictionary_encode()
    own = pa.concat_arrays([coded.dictionary, pa.array([END])])
    hashes = word_hashes(own)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = np.diff(starts) + 1
    codes = np.empty(sizes.sum(), np.int64)
    last = np.zeros(len(codes), bool)
    last[np.cumsum(sizes) - 1] = True
    codes[last] = rank[-1]
    codes[~last] = rank[np.asarray(coded.indices)] if len(found) else 0
    held = lambda flags: np.bincount(codes[np.repeat(np.asarray(flags), sizes)], minlength=len(own))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    chunk = int.from_bytes(os.urandom(8), "little") >> 1
    return pa.record_batch(
        [pa.array([chunk]), one(ids), one(train), one(fold), one(pa.array(sizes.astype(np.int32))), pa.array([pack(codes)]), one(own.take(pa.array(order))), pa.array([pack(held(train))]), pa.array([pack(held(fold))])],
        names=[c.split()[0] for c in CHUNKS.split(", ")],
    )


def chunks(docs: DataFrame, train: Column, fold: Column, at: str) -> DataFrame:
    """Rows of ``CHUNKS`` over all documents, written to ``at``; ``fold`` is a part of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            for part in sized(batch, "text"):
                texts = texts_of(part, "text")
                for kept, column in zip(held, (part.column("doc_id"), part.column("train"), part.column("fold"), texts), strict=True):
                    kept.append(column)
                size += texts.nbytes
                if size >= CHUNK:
                    yield chunk_row(*held)
                    held, size = ([], [], [], []), 0
                    release()
        if held[0]:
            yield chunk_row(*held)
        release()

    train = F.coalesce(train, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"), (train & F.coalesce(fold, F.lit(False))).alias("fold"))
    with small_batches(docs.sparkSession):
        return written_to(own.mapInArrow(run, CHUNKS), at)


def bits_for(items: int) -> int:
    """Buckets are a power of two, of about ``BUCKET`` items each."""
    return max(0, (-(-items // BUCKET) - 1).bit_length())


def cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets - the first ``bits`` bits - that sorted hashes meet, and where each begins (plus the end)."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[begins], np.append(begins, len(hashes))


def word_answers(own: DataFrame, bits: int, at: str) -> DataFrame:
    """Rows of ``ANSWERS`` for the words of ``CHUNKS``: id, training count and fold count of each word of a block in the chunk's order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column("words")[row].values.cast(pa.binary())
                n, h = counts_of(batch.column("n")[row].as_py()), counts_of(batch.column("h")[row].as_py())
                bucket, cut = cuts(word_hashes(found), bits)
                ends = pa.array(cut.astype(np.int32))
                chunk = np.full(len(bucket), batch.column("chunk")[row].as_py(), np.int64)
                yield pa.record_batch([pa.array(chunk), pa.array(bucket.astype(np.int32)), pa.ListArray.from_arrays(ends, found), *(pa.array([pack(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)]) for x in (n, h))], names=["chunk", "bucket", "words", "n", "h"])
                release()

    def add(group: pa.Table) -> pa.Table:
        lists = group.column("words").combine_chunks()
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        codes, ends = np.asarray(coded.indices), np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
        c, h = (np.bincount(codes, np.concatenate([counts_of(x) for x in group.column(name).to_pylist()]), len(coded.dictionary)).astype(np.int64) for name in ("n", "h"))
        ids = (codes.astype(np.int64) << bits) | group.column("bucket")[0].as_py()
        return answers(group, ends, ids, c[codes], h[codes], ((c > 0).sum(), c.sum(), h.sum()))

    sent = own.select("chunk", "words", "n", "h").mapInArrow(blocks, "chunk long, bucket int, words array<binary>, n binary, h binary")
    return written_to(sent.groupBy("bucket").applyInArrow(add, ANSWERS), at)


def answers(group: pa.Table, ends: np.ndarray, ids: np.ndarray | None, c: np.ndarray, h: np.ndarray, totals: tuple = (None, None, None)) -> pa.Table:
    """Rows of ``ANSWERS`` to the blocks of a bucket; the first holds the bucket's totals."""
    parts = lambda a: pa.array([None if a is None else pack(a[x:y]) for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
    rest = [pa.array([int(t) if t is not None and n == 0 else None for n in range(len(group))], pa.int64()) for t in totals]
    return pa.table([group.column("chunk").combine_chunks(), group.column("bucket").combine_chunks(), parts(ids), parts(c), parts(h), *rest], names=[x.split()[0] for x in ANSWERS.split(", ")])


def joined_rows(own: DataFrame, found: list[DataFrame], join, schema: str) -> DataFrame:
    """``join`` (row of ``own``, answers of each of ``found``) of each chunk, as rows of ``schema``; answers come in the chunk's order."""
    kept, asked = own.columns, len(found)
    rows = own.withColumns({"kind": F.lit(-1), "bucket": F.lit(-1)} | {f"a_{c}": F.lit(None).cast("binary") for c in ("ids", "c", "h")})
    for kind, df in enumerate(found):
        rows = rows.unionByName(df.select("chunk", "bucket", F.lit(kind).alias("kind"), *(F.col(c).alias(f"a_{c}") for c in ("ids", "c", "h"))), allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        kinds, buckets = np.asarray(group.column("kind")), np.asarray(group.column("bucket"))
        row = group.select(kept).take([int(np.flatnonzero(kinds < 0)[0])])
        answers = []
        for kind in range(asked):
            at = np.flatnonzero(kinds == kind)
            at = at[np.argsort(buckets[at])].tolist()
            columns = (group.column(f"a_{c}").take(at).to_pylist() for c in ("ids", "c", "h"))
            answers.append([np.concatenate([np.zeros(0, np.int64), *(counts_of(x) for x in column if x is not None)]) for column in columns])
        out = join(row, answers)
        release()
        return out

    return rows.groupBy("chunk").applyInArrow(run, schema)


def with_words(row: pa.Table, answers: list) -> pa.Table:
    ids, c, h = answers[0]
    return row.drop_columns(["words", "n", "h"]).append_column("ids", pa.array([pack(ids)])).append_column("c", pa.array([pack(c)])).append_column("h", pa.array([pack(h)]))


def keys_of(tokens: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` tokens that end at each token; what comes before a document is one token of its own."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = mix(tokens.astype(np.uint64) + np.uint64(1))
    key = own
    for back in range(1, order):
        before = np.zeros(len(tokens), np.uint64)
        before[back:] = own[: len(own) - back] if back < len(own) else own[:0]
        before[place < back] = 0
        key = mix(key * np.uint64(3) + before)
    return key


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each begins in sorted order, and the sorting order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    return ordered[begins], begins, order


def added(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else np.zeros(0, np.int64)


def tokens_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Global ids, sizes of documents, training and fold flags of documents, and word counts (all, fold) of each token of a coded chunk."""
    codes = counts_of(row["codes"][0].as_py())
    sizes, train, fold = (np.asarray(row[c][0].values) for c in ("sizes", "train", "fold"))
    return counts_of(row["ids"][0].as_py())[codes], sizes.astype(np.int64), train, fold, counts_of(row["c"][0].as_py())[codes], counts_of(row["h"][0].as_py())[codes]


def gram_answers(own: DataFrame, order: int, bits: int, at: str) -> DataFrame:
    """Rows of ``ANSWERS`` for the distinct n-grams of each chunk, in order of their hashes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, sizes, train, fold, *_ = tokens_of({c: batch.column(c).slice(row, 1) for c in batch.schema.names})
                keys, begins, by = grouped(keys_of(tokens, sizes, order))
                n, h = (added(np.repeat(flags, sizes)[by].astype(np.int64), begins) for flags in (train, fold))
                bucket, cut = cuts(keys, bits)
                steps = [np.diff(keys[a:b], prepend=np.uint64(0)) for a, b in zip(cut, cut[1:], strict=False)]
                chunk = np.full(len(bucket), batch.column("chunk")[row].as_py(), np.int64)
                yield pa.record_batch([pa.array(chunk), pa.array(bucket.astype(np.int32)), pa.array([pack(x) for x in steps], pa.binary()), *(pa.array([pack(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (n, h))], names=["chunk", "bucket", "keys", "n", "h"])
                release()

    def add(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpack(x).astype(np.uint64)) for x in group.column("keys").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        _, begins, by = grouped(np.concatenate(parts))
        place = np.empty(len(by), np.int64)
        place[by] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(by))))
        c, h = (added(np.concatenate([counts_of(x) for x in group.column(name).to_pylist()])[by], begins)[place] for name in ("n", "h"))
        out = answers(group, ends, None, c, h)
        release()
        return out

    sent = own.mapInArrow(blocks, "chunk long, bucket int, keys binary, n binary, h binary")
    return written_to(sent.groupBy("bucket").applyInArrow(add, ANSWERS), at)


def with_counts(row: pa.Table, answers: list, order: int) -> pa.Table:
    """A row of ``JOINED``: the counts of each token's n-grams, of one to ``order`` words, and the fold's share of them."""
    tokens, sizes, _, _, c1, h1 = tokens_of(row)
    counts, held = [c1], [h1]
    for n, (_, c, h) in enumerate(answers, 2):
        _, begins, by = grouped(keys_of(tokens, sizes, n))
        for out, values in ((counts, c), (held, h)):
            own = np.empty(len(by), np.int64)
            own[by] = np.repeat(values, np.diff(np.append(begins, len(by))))
            out.append(own)
    fold = np.repeat(np.asarray(row["fold"][0].values), sizes)
    own = row.select(["doc_id", "train", "fold", "sizes"])
    return own.append_column("counts", pa.array([[pack(x) for x in counts]], pa.list_(pa.binary()))).append_column("held", pa.array([[pack(np.where(fold, x, 0)) for x in held]], pa.list_(pa.binary())))


def contexts(counts: list[np.ndarray], sizes: np.ndarray, tokens: int, documents: int) -> list[np.ndarray]:
    """How often the context of each order was seen: all tokens, then the count of the n-gram that ends before the token; a
    document's first token follows the start, which was seen in every document."""
    first = np.cumsum(sizes) - sizes
    out = [np.full(len(counts[0]), tokens)]
    for c in counts[:-1]:
        before = np.empty(len(c), np.int64)
        before[1:] = c[:-1]
        before[first] = documents
        out.append(before)
    return out


def shares(counts: list[np.ndarray], context: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates and context buckets of each order; bucket 0 is a context never seen."""
    f = [np.divide(c, n, out=np.zeros(len(c)), where=n > 0) for c, n in zip(counts, context, strict=True)]
    buckets = [np.frexp(n.astype(np.float64))[1] for n in context]
    buckets[0] = np.minimum(buckets[0], 1)  # the empty context is one bucket
    return f, buckets


def probability(f: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, even: float) -> np.ndarray:
    """P of each token; ``weights`` has a row of buckets for each order."""
    p = np.full(len(f[0]), even)
    for own, b, w in zip(f, buckets, weights, strict=True):
        p = w[b] * own + (1 - w[b]) * p
    return p


def expected(f: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, even: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens that each order and bucket gave, and that reached it (from above, or not at all)."""
    left, parts = np.ones(len(f[0])), []
    for own, b, w in zip(f[::-1], buckets[::-1], weights[::-1], strict=True):
        parts.append(left * w[b] * own)
        left = left * (1 - w[b])
    below = left * even
    whole = sum(parts) + below
    gave, reached = np.zeros((len(f), BUCKETS)), np.zeros((len(f), BUCKETS))
    for k, (b, part) in enumerate(zip(buckets, parts[::-1], strict=True)):
        below = below + part
        gave[k] = np.bincount(b, part / whole, BUCKETS)
        reached[k] = np.bincount(b, below / whole, BUCKETS)
    return gave, reached


def learn(joined: DataFrame, order: int, types: int, tokens: int, held: int, documents: int, held_documents: int, rounds: int, settled: float) -> np.ndarray:
    """Mixture weights by expectation-maximisation over the fold's tokens, whose own counts are taken off."""
    even = 1 / (types + 1)
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[row].values).astype(np.int64)
                fold = np.repeat(np.asarray(batch.column("fold")[row].values), sizes)
                if fold.any():
                    c, h = ([counts_of(x) for x in batch.column(name)[row].as_py()] for name in ("counts", "held"))
                    left = [a - b for a, b in zip(c, h, strict=True)]
                    f, buckets = shares(left, contexts(left, sizes, tokens - held, documents - held_documents))
                    flat = b"".join(x[fold].astype(t).tobytes() for xs, t in ((f, np.float32), (buckets, np.uint8)) for x in xs)
                    yield pa.record_batch([pa.array([flat])], names=["data"])
                    del c, h, left, f, buckets, flat
                release()

    own = written(joined.select("sizes", "fold", "counts", "held").mapInArrow(estimates, "data binary"), "lm-fold")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, order, BUCKETS))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                n = len(data) // (5 * order)
                f = np.frombuffer(data, np.float32, n * order).reshape(order, n).astype(np.float64)
                buckets = np.frombuffer(data, np.uint8, offset=4 * n * order).reshape(order, n)
                total += expected(list(f), list(buckets), weights, even)
        release()
        some = np.flatnonzero(total.ravel())
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total.ravel()[some])], names=["at", "n"])

    for _ in range(rounds):
        total = np.zeros(2 * order * BUCKETS)
        for at, n in own.mapInArrow(step, "at int, n double").groupBy("at").sum("n").collect():  # a few numbers for each order and bucket
            total[at] = n
        gave, reached = total.reshape(2, order, BUCKETS)
        new = (gave + 0.5) / (reached + 1)
        new[:, 0] = 0
        moved = np.abs(new - weights).max()
        weights = new
        if moved < settled:
            break
    return np.round(weights, 6)


def score(docs: DataFrame, train: Column, fold: Column, order: int = 3, rounds: int = 30, settled: float = 1e-3) -> DataFrame:
    """Rows of ``SCORED`` and train_tokens of all documents (doc_id, text): the model's log10 probability of each text, learned from the ``train``
    documents, whose ``fold`` part holds out the tokens that the mixture weights are learned on; base_score is that of counts plus one."""
    spark = docs.sparkSession
    at = {name: work_path(spark, f"lm-{name}") for name in ("chunks", "words", "coded", *range(2, order + 1))}
    own = chunks(docs, train, fold, at["chunks"])
    found, size, documents, held_documents = own.agg(F.sum(F.size("words")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("train", lambda x: x))), F.sum(F.size(F.filter("fold", lambda x: x)))).first()
    if not found:
        return spark.createDataFrame([], SCORED + ", train_tokens long")
    answered = word_answers(own, bits_for(found), at["words"])
    types, tokens, held = answered.agg(F.sum("types"), F.sum("tokens"), F.sum("held")).first()
    coded = written_to(joined_rows(own, [answered], with_words, CODED), at["coded"])
    for name in ("chunks", "words"):
        remove(spark, at.pop(name))
    grams = [gram_answers(coded, n, bits_for(size), at[n]) for n in range(2, order + 1)]
    joined = written(joined_rows(coded, grams, lambda row, answers: with_counts(row, answers, order), JOINED), "lm-counts")
    for path in at.values():
        remove(spark, path)
    weights = learn(joined, order, types, tokens, held, documents, held_documents, rounds, settled)
    even = 1 / (types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[row].values).astype(np.int64)
                c = [counts_of(x) for x in batch.column("counts")[row].as_py()]
                first = np.cumsum(sizes) - sizes
                p = probability(*shares(c, contexts(c, sizes, tokens, documents)), weights, even)
                sums = [np.add.reduceat(x, first) for x in ((c[0] > 0).astype(np.int64), np.log10((c[0] + 1) / (tokens + types + 1)), np.log10(p))]
                ids, train = batch.column("doc_id")[row].values, np.asarray(batch.column("train")[row].values)
                yield pa.record_batch([ids, pa.array(~train), pa.array(sizes), *map(pa.array, sums)], names=[x.split()[0] for x in SCORED.split(", ")])
                release()

    return joined.select("doc_id", "train", "sizes", "counts").mapInArrow(run, SCORED).withColumn("train_tokens", F.lit(tokens).cast("long"))


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those whose crc32 leaves no remainder of 2 by 7; one in 20 of these holds out tokens for the weights."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, crc % 7 != 2, F.floor(crc / 7) % 20 == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
