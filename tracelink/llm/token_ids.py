"""Token ids in binary shards: one zstandard frame per document, one shared dictionary.

Shard layout, little endian::

    magic "TLSHARD1" | sha-256 of the dictionary (32 bytes) | id width (1 byte)
    frames, one per document, in ascending doc_id order
    index: doc_id int64[n], known uint8[n] (0: the id is null), frame end uint64[n], tokens uint64[n]
    n uint64 | offset of the index uint64 | magic

A frame is the id array (uint16, or uint32 for vocabularies over 65,536 ids) compressed alone with the
dictionary, so one document is read by one seek to the index and one to its frame.

Edge cases: a null text is an empty text (its array holds the end id alone); rows with the same doc_id
are kept, ordered by the hash of their frame; a null doc_id comes first; an empty table gives no
shard; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelink.llm.common import SegmentIds, Segments, filesystem, hash_sample, release, sized, small_batches, strings, texts_of, unique_name
from tracelink.session import remove, work_path

MAGIC = b"TLSHARD1"
HEAD = 8 + 32 + 1
LEVEL = 3
#: A non-space character before a blank: the pre-tokenizer always ends a match there.
CUT = r"([^\s\x0b\x1c-\x1f\x85\pZ])( )"
#: Texts with a blank at the start or after other white space.
HARD = r"^ |[\s\x0b\x1c-\x1f\x85\pZ] "


class Encoder:
    """Encodes segments with the tokenizers library, many in one call.

    Segments that start with a blank and end with another character are joined before encoding, as
    no match crosses their borders, and told apart again by the tokens' bytes.
    """

    JOINED = 256
    #: Groups of joined segments in one call: what the library returns is many times larger than the ids kept of it.
    CALLED = 48

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(self.size, np.int64)  # byte-level tokens have one character for a byte
        for token, i in tokens.items():
            self.bytes[i] = added.get(i, len(token))
        self.segments = SegmentIds(self.encode)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        #: Whether texts may be cut before blanks: only where the byte-level pattern alone says where matches end.
        self.cuts = parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())

    def _call(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of each word's ids."""
        joins = np.fromiter((self.cuts and w[:1] == " " and not w[-1].isspace() for w in words), bool, len(words))
        ids: list = [None] * len(words)
        alone = np.flatnonzero(~joins).tolist()
        together = np.flatnonzero(joins).tolist()
        groups = [together[i : i + self.JOINED] for i in range(0, len(together), self.JOINED)]
        calls = (self._call(["".join(words[i] for i in g) for g in groups[at : at + self.CALLED]]) for at in range(0, len(groups), self.CALLED))
        for group, got in zip(groups, chain.from_iterable(calls), strict=True):
            got = np.array(got, np.uint32)
            ends = np.cumsum(self.bytes[got])
            borders = np.cumsum([len(words[i].encode()) for i in group])
            cuts = np.searchsorted(ends, borders)
            if not len(got) or ends[-1] != borders[-1] or (ends[cuts] != borders).any():
                alone += group  # a tokenizer that is not byte-level after all
                continue
            for i, a, b in zip(group, [0, *(cuts[:-1] + 1)], cuts + 1, strict=True):
                ids[i] = got[a:b]
        for at in range(0, len(alone), self.JOINED):
            part = alone[at : at + self.JOINED]
            for i, got in zip(part, self._call([words[i] for i in part]), strict=True):
                ids[i] = np.array(got, np.uint32)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), n


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(texts: pa.Array, path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text, with ``end_id`` appended. A tokenizer that no cut is known to be safe for gets whole texts."""
    if not _encoder(path).cuts:
        ids, n = _encoder(path).encode(strings(texts))
        ends = np.cumsum(n)
        return [np.append(ids[b - k : b], np.uint32(end_id)) for b, k in zip(ends, n, strict=True)]
    words, codes, starts = Segments(CUT, HARD)(texts)
    ids, n = _encoder(path).segments.gather(strings(words), codes)
    total = np.concatenate([[0], np.cumsum(n)])
    out = [np.append(ids[total[a] : total[b]], np.uint32(end_id)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return out


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where there are too few samples to train, their own bytes serve as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:].rjust(8, b"\0")


def _samples(docs: DataFrame, path: str, end_id: int, kind: str, documents: int, most: int) -> list[bytes]:
    """Serialized id arrays of a sample, encoded in tasks and fetched one partition after the other up to ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                yield pa.record_batch([pa.array([x.astype(kind).tobytes() for x in encode_texts(texts_of(part, "text"), path, end_id)], pa.binary())], names=["ids"])

    out, size = [], 0
    for row in hash_sample(docs.select("doc_id", "text"), "doc_id", documents).select("text").mapInArrow(run, "ids binary").toLocalIterator():
        if out and size + len(row.ids) > most:
            break
        out.append(bytes(row.ids))
        size += len(row.ids)
    return out


def write_shards(
    docs: DataFrame,
    directory: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    dictionary_docs: int = 512,
    dictionary_bytes: int = 65_536,
    sample_bytes: int = 32 << 20,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards to ``directory``; returns the manifest.

    The dictionary is trained on the id arrays of ``dictionary_docs`` documents (smallest hash of
    doc_id, ``sample_bytes`` at most); it changes the size of the files, never their content. All documents are encoded once,
    into a staged table of frames; only frames are shuffled, by range of doc_id.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    wide = 2 if max(_encoder(path).size, end_id + 1) <= 65_536 else 4
    kind = f"<u{wide}"
    dictionary = train_dictionary(_samples(docs, path, end_id, kind, dictionary_docs, sample_bytes), dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for part in sized(batch, "text"):
                ids = encode_texts(texts_of(part, "text"), path, end_id)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([packer.compress(x.astype(kind).tobytes()) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])
                del ids
                release()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, ids, ends, counts, at = unique_name("shard", ".tls"), None, [], [], [], HEAD
        store, top = filesystem(directory)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}")
                out.write(MAGIC + digest + bytes([wide]))
            for frame in batch.column("frame"):
                out.write(frame.as_buffer())
                at += len(frame.as_buffer())
                ends.append(at)
            ids.append(batch.column("doc_id"))
            counts.append(batch.column("n_tokens").to_numpy())
        if out is None:
            return
        key = pa.chunked_array(ids, pa.int64())
        known = np.asarray(key.is_valid()).astype(np.uint8)
        n_tokens = np.concatenate(counts).astype("<u8")
        out.write(np.asarray(key.fill_null(0)).astype("<i8").tobytes() + known.tobytes() + np.array(ends, "<u8").tobytes() + n_tokens.tobytes())
        out.write(struct.pack("<QQ", len(ends), at) + MAGIC)
        out.close()
        row = {"shard": TaskContext.get().partitionId(), "file": name, "first_doc": key[0].as_py(), "last_doc": key[-1].as_py(), "n_docs": len(ends), "n_tokens": int(n_tokens.sum()), "n_bytes": at}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    staged = work_path(spark, "frames")
    with small_batches(spark):
        docs.select("doc_id", "text").mapInArrow(frames, "doc_id long, n_tokens long, frame binary").write.option("compression", "none").parquet(staged)
    table = spark.read.parquet(staged)
    total = table.select(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    order = ["doc_id", F.xxhash64("frame")]
    manifest = f"{directory}/manifest"
    table.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).mapInArrow(shard, "shard long, file string, first_doc long, last_doc long, n_docs long, n_tokens long, n_bytes long").write.parquet(manifest)
    remove(spark, staged)
    store, top = filesystem(directory)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/{digest.hex()}.zdict") as out:
        out.write(dictionary)
    return read_manifest(spark, directory)


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Shards in ascending doc_id order with ``start``, the number of tokens in all shards before.

    The window runs over one row per shard.
    """
    return spark.read.parquet(f"{directory}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class Shard:
    """One open shard: its index, and documents by position."""

    def __init__(self, directory: str, name: str, cache: dict | None = None) -> None:
        self.store, self.top = filesystem(directory)
        self.file = self.store.open_input_file(f"{self.top}/{name}")
        size = self.file.size()
        n, at, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        head = self.file.read_at(HEAD, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{name} is not a shard")
        index = self.file.read_at(25 * n, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.known = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.ends = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.n_tokens = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.kind, digest = f"<u{head[40]}", head[8:40]
        cache = {} if cache is None else cache
        if digest not in cache:
            with self.store.open_input_stream(f"{self.top}/{digest.hex()}.zdict") as f:
                data = f.read()
            if hashlib.sha256(data).digest() != digest:
                raise ValueError("the dictionary does not have the shard's hash")
            cache[digest] = zstandard.ZstdCompressionDict(data)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=cache[digest])

    def ids(self, i: int) -> np.ndarray:
        lo = int(self.ends[i - 1]) if i else HEAD
        data = self.unpacker.decompress(self.file.read_at(int(self.ends[i]) - lo, lo), max_output_size=max(1, int(self.n_tokens[i]) * 4))
        return np.frombuffer(data, self.kind)

    def all_ids(self, block: int = 8 << 20) -> Iterator[np.ndarray]:
        """Every document's ids in order, read in blocks of about ``block`` bytes."""
        starts = np.concatenate([[HEAD], self.ends[:-1]])
        i = 0
        while i < len(self.ends):
            j = max(i + 1, int(np.searchsorted(self.ends, starts[i] + block, side="right")))
            data = self.file.read_at(int(self.ends[j - 1] - starts[i]), int(starts[i]))
            for k in range(i, j):
                frame = data[starts[k] - starts[i] : self.ends[k] - starts[i]]
                yield np.frombuffer(self.unpacker.decompress(frame, max_output_size=max(1, int(self.n_tokens[k]) * 4)), self.kind)
            i = j

    def close(self) -> None:
        self.file.close()


def read_document(spark: SparkSession, directory: str, doc_id: int) -> list[np.ndarray]:
    """Id arrays of a document (several, if its doc_id repeats): manifest, index and frame are all that is read."""
    near = read_manifest(spark, directory).where((F.lit(doc_id) <= F.col("last_doc")) & (F.coalesce("first_doc", F.lit(doc_id)) <= doc_id)).orderBy("shard").collect()
    out = []
    for row in near:
        shard = Shard(directory, row["file"])
        out += [shard.ids(int(i)) for i in np.flatnonzero((shard.doc_ids == doc_id) & shard.known)]
        shard.close()
    return out


def read_shards(spark: SparkSession, directory: str, ids: bool = False) -> DataFrame:
    """Every stored document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(directory, row["file"], cache)
                crcs, arrays, done = [], [], 0
                starts = row["start"] + np.cumsum(shard.n_tokens) - shard.n_tokens

                def flush(done, shard=shard, starts=starts):
                    to = done + len(crcs)
                    own = [pa.array(shard.doc_ids[done:to], mask=~shard.known[done:to]), pa.array(starts[done:to]), pa.array(shard.n_tokens[done:to]), pa.array(crcs, pa.int64())]
                    return pa.record_batch(own + [pa.array(arrays, pa.list_(pa.int64()))] * ids, schema=pa.schema(fields))

                for x in shard.all_ids():
                    crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if ids:
                        arrays.append(x.astype(np.int64))
                    if len(crcs) >= 4096:
                        yield flush(done)
                        done += len(crcs)
                        crcs.clear(), arrays.clear()
                if crcs:
                    yield flush(done)
                shard.close()

    shards = read_manifest(spark, directory).select("shard", "file", "start")
    n = max(1, spark.read.parquet(f"{directory}/manifest").count())
    return shards.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to shards and read back from them."""
    directory = work_path(spark, "token-ids")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), directory)
    return read_shards(spark, directory)
