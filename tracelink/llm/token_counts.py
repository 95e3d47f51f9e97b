"""Token counts by a two-tier lookup, without shuffling any pre-token.

A pre-token is a run of blanks with the characters up to the next blank. No piece of the model has a
blank after another character (``_check`` verifies it), so no merge crosses the cut and the lengths of
a text's pre-tokens add up to the text's length.

First tier: a broadcast hash table of the most frequent pre-tokens of a sample of documents and their
lengths (at most ``table_size`` entries). Second tier: each worker encodes what is not in the table
and keeps it in a bounded cache. The tiers decide the speed only; every text is counted whole.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import Segments, hash_sample, sized, strings, sums, texts_of

SPACE = "▁"  # the model writes a blank so
CUT = f"([^ {SPACE}])( )"
#: Texts with a blank at the start or after a blank or the model's own sign for one.
HARD = f"^ |[ {SPACE}] "
CACHED = 500_000
LONGEST = 64

_models: dict[str, PieceLengths] = {}


class PieceLengths:
    """Lengths of pre-tokens by the model, with the worker's cache."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, int] = {}
        self._check()

    def _check(self) -> None:
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses a blank: pre-tokens can't be counted alone")

    def __call__(self, keys: list[str]) -> np.ndarray:
        """Token number of each key as it stands after a blank."""
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        missing = [k for k in keys if k not in cache]
        extra = {}
        for k, ids in zip(missing, self.model.encode(missing, num_threads=1) if missing else [], strict=True):
            (cache if len(k) <= LONGEST else extra)[k] = len(ids) if k else 1  # a lone blank at the end
        return np.fromiter((cache[k] if k in cache else extra[k] for k in keys), np.int64, len(keys))


def _model(path: str) -> PieceLengths:
    if path not in _models:
        _models[path] = PieceLengths(path)
    return _models[path]


def _keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens without their first blank. A text's first pre-token gets that blank from the
    model; ``count_tokens`` gives an empty text none."""
    words, codes, starts = Segments(CUT, HARD, " ")(texts)
    return pc.utf8_slice_codeunits(words, 1), codes, starts


class LengthTable:
    """Lengths of frequent pre-tokens in an open-addressing hash table: slots hold a key's number, or -1, and keys
    stand in the first free slot from their hash on. Keys are one string buffer; a hit is compared with its key."""

    def __init__(self, keys: list[str], lengths: np.ndarray) -> None:
        self.keys = pa.array(keys, pa.large_string())
        self.lengths = lengths.astype(np.uint16)
        bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        hashes = self._hashes(keys)
        self.hashes = hashes
        at, todo = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] < 0
            taking, first = np.unique(at[todo[free]], return_index=True)  # of those that want one slot the first gets it
            self.slots[taking] = todo[free][first]
            todo = todo[self.slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Length of each word, -1 where the table has none."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        hashes = self._hashes(strings(words))
        at, todo = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(words))
        while len(todo):
            key = self.slots[at[todo]]
            todo, key = todo[key >= 0], key[key >= 0]
            same = self.hashes[key] == hashes[todo]
            hit, found = todo[same], key[same]
            equal = np.asarray(pc.equal(words.take(pa.array(hit)), self.keys.take(pa.array(found))))
            out[hit[equal]] = self.lengths[found[equal]]
            todo = np.concatenate([todo[~same], hit[~equal]])
            at[todo] = (at[todo] + 1) & self.mask
        return out


def frequent_lengths(docs: DataFrame, model: str, sample_docs: int, table_size: int) -> LengthTable:
    """The first tier. The sample's pre-tokens are counted in tasks; the driver gets the table's entries alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                words, codes, _ = _keys(texts_of(part, "text"))
                yield pa.record_batch([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    rows = hash_sample(docs.select("doc_id", "text"), "doc_id", sample_docs).select("text").mapInArrow(count, "word string, n long")
    often = rows.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size)
    top = [r.word for r in often.select("word").collect()]
    return LengthTable(top, _model(model)(top))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, sample_docs: int = 512, table_size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                texts = texts_of(part, "text")
                words, codes, starts = _keys(texts)
                own = table.value(words)
                miss = own < 0
                own[miss] = _model(path)(strings(words.filter(pa.array(miss))))
                size = np.asarray(pc.binary_length(texts)).astype(np.int64)
                n = np.where(size > 0, sums(own[codes], starts), 0)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
