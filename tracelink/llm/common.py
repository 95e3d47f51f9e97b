"""Helpers that several operators share: text batches, safe cuts, samples and files."""

from __future__ import annotations

import ctypes
import os
import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: glibc's call, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

#: Bytes of text handled at once inside a task.
BATCH_BYTES = 6 << 20


def sized(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about ``limit`` bytes of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with null as empty; large offsets, so that splits cannot overflow."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


#: Each byte as it is, but A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: pa.Array, apart: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of some large-string texts, A-Z lower-cased, as one binary array, and the place of each text's first word (plus the end).
    Words are the longest runs of bytes that ``apart`` (256 booleans) does not mark; no byte of a longer UTF-8 character may be marked."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]  # a word does not go on in the next text
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64) if len(data) else np.zeros(0, np.int32)
    kept = LOWER[data[inside]]
    if len(kept) >= 1 << 31:
        raise ValueError("texts of 2 GiB or more in one batch")
    ends = np.empty(len(starts) + 1, np.int32)
    ends[:-1], ends[-1] = before[starts] - 1, len(kept)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), np.searchsorted(starts, offsets)


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of ``size`` ids with the smallest hashes, at most ``4 * size`` rows: the ids are chosen from the key column alone,
    each task keeping its ``size`` smallest, so only the chosen rows' other columns are read."""
    own = F.col(key)
    ids = {r[0] for r in df.select(own).where(own.isNotNull()).orderBy(F.xxhash64(own), own).limit(size).collect()}
    return df.where(own.isin(list(ids))).limit(4 * size) if ids else df.limit(0)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI, for tasks that write their own format."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def unique_name(prefix: str, suffix: str) -> str:
    """A name no other task attempt uses, so a repeated attempt never overwrites a file in use."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def save(directory: str, kind: str, value) -> str:
    """Store a value in a file of its own under ``directory``, a folder that all executors share; returns the file's name."""
    store, to = filesystem(directory)
    store.create_dir(to, recursive=True)
    name = unique_name(kind, ".bin")
    with store.open_output_stream(f"{to}/{name}", compression=None) as out:
        out.write(pickle.dumps(value, protocol=5))
    return name


def load(directory: str, name: str):
    """The value of a file that ``save`` wrote in this job."""
    store, to = filesystem(directory)
    with store.open_input_stream(f"{to}/{name}", compression=None) as f:
        return pickle.loads(f.read())


class Segments:
    """Cuts texts where no token can cross, so that equal segments are encoded once per worker.

    ``cut`` is an RE2 pattern of two groups: the text is cut between them, before a blank (and before
    whatever else the pattern says, in texts that match ``hard``; other texts are cut before every
    blank). Each text, with ``prefix`` before it, is the concatenation of its segments; without a prefix
    an empty text has one empty segment.
    """

    MARK = "\x00"

    def __init__(self, cut: str, hard: str, prefix: str = "") -> None:
        self.cut, self.hard, self.prefix = cut, hard, prefix

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct segments, code of each segment in order, and first segment of each text (plus the end)."""
        marked = pc.replace_substring(texts, pattern=" ", replacement=self.MARK + " ")
        hard = pc.match_substring_regex(texts, pattern=self.hard)
        if pc.any(hard).as_py():
            marked = pc.replace_with_mask(marked, hard, pc.replace_substring_regex(texts.filter(hard), pattern=self.cut, replacement=r"\1" + self.MARK + r"\2"))
        if self.prefix:
            marked = pc.binary_join_element_wise(pa.scalar(self.prefix, marked.type), marked, pa.scalar("", marked.type))
        lists = pc.split_pattern(marked, self.MARK)
        odd = pc.match_substring(texts, self.MARK)
        if pc.any(odd).as_py():  # a text that holds the mark itself stays one segment
            rows = [[self.prefix + t] if o else x for t, o, x in zip(texts.to_pylist(), odd.to_pylist(), lists.to_pylist(), strict=True)]
            lists = pa.array(rows, pa.list_(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        starts = np.asarray(lists.offsets, dtype=np.int64)
        return coded.dictionary, np.asarray(coded.indices), starts - starts[0]


def strings(words: pa.Array) -> list[str]:
    """An Arrow string array as a list; quicker than to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


class SegmentIds:
    """Ids of segments, kept per worker in two generations of at most ``most`` segments: what is used goes
    over to the younger one, and the older one is forgotten when the younger is full."""

    def __init__(self, encode, most: int = 200_000, longest: int = 48) -> None:
        self.encode, self.most, self.longest = encode, most, longest
        self.old, self.young = self._empty(), self._empty()

    @staticmethod
    def _empty() -> tuple[dict[str, int], list[np.ndarray], list[np.ndarray]]:
        return {}, [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def _put(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        place, sizes, stored = self.young
        place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
        sizes.append(lengths), stored.append(ids)

    def gather(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the coded segments in order, and the number of ids of each coded segment."""
        if len(self.young[0]) > self.most:
            self.old, self.young = self.young, self._empty()
        at = np.full(len(words), -1, np.int64)
        lengths = np.zeros(len(words), np.int64)
        parts, base = [], 0
        for place, sizes, stored in (self.young, self.old):
            if not place:
                continue
            sizes[:], stored[:] = [np.concatenate(sizes)], [np.concatenate(stored)]
            found = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
            new = np.flatnonzero((found >= 0) & (at < 0))
            ends = np.cumsum(sizes[0])
            lengths[new] = sizes[0][found[new]]
            at[new] = base + ends[found[new]] - lengths[new]
            if stored is self.old[2] and len(new):
                self._put([words[i] for i in new], lengths[new], spread(stored[0], at[new] - base, lengths[new]))
            parts.append(stored[0])
            base += len(stored[0])
        new = np.flatnonzero(at < 0)
        if len(new):
            own = [words[i] for i in new]
            ids, n = self.encode(own)
            lengths[new], at[new] = n, base + np.cumsum(n) - n
            parts.append(ids)
            short = np.fromiter(map(len, own), np.int64, len(own)) <= self.longest
            kept = np.flatnonzero(short)
            self._put([own[i] for i in kept], n[kept], spread(ids, (np.cumsum(n) - n)[kept], n[kept]))
        n = lengths[codes]
        return spread(np.concatenate([np.zeros(0, np.uint32), *parts]), at[codes], n), n


def release() -> None:
    """Give memory that is free inside this process back to the system: workers live on between tasks, side by side."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + n[i]] of every i, one after the other."""
    ends = np.cumsum(n)
    if not len(n) or not ends[-1]:
        return flat[:0]
    index = np.repeat(at - (ends - n), n)
    index += np.arange(ends[-1])
    return flat[index]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each [starts[i], starts[i+1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]
