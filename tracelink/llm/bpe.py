"""Byte-level BPE as a tree reduction: halves are encoded apart and joined at their boundary.

An encoded span is an element of a monoid whose product joins two neighbours. Two levels use it:

*Text.* A safe cut is a place where the splitting pattern always ends a match, whatever stands further
left: before a blank or line feed that follows a non-space character, between an ASCII letter and an
ASCII digit, and after an ASCII letter or digit before ASCII punctuation. (No alternative of the
pattern has such a pair inside a match, and a scan started at a match start does not look back.)
Joining looks for the nearest safe cut left and right of the boundary in windows that double, encodes
the text between the two again and replaces the tokens there; tokens outside lie in matches that no
longer change.

*One long match.* Its bytes are halved, and the join encodes again the last k tokens of the left and the
first k of the right, k doubling, until both edges of the window are stable. A pair of neighbours is
stable if the two tokens' joined bytes encode to just these two; a token sequence whose tokens are
proper and whose neighbours are all stable is the encoding of its bytes, so the test is a proof.

Decoding concatenates the bytes of halves up the same tree.

Edge cases: a null text is empty (no tokens); repeated rows give repeated rows; an empty table gives an
empty result; other columns of the input are ignored. No special tokens are used.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tracelink.llm.common import sized, texts_of

#: Characters, bytes and tokens that a leaf of the tree holds at most.
LEAF_CHARS, LEAF_BYTES, LEAF_TOKENS = 512, 512, 2048
#: A window over this many characters is split into its matches, and long matches are halved.
WIDE = 4096


def safe_cut(text: str, at: int) -> bool:
    """Whether the pattern ends a match at ``at`` for certain (0 < at < len(text))."""
    a, b = text[at - 1], text[at]
    if b == " " or b == "\n":
        return not a.isspace()
    if not (a.isascii() and b.isascii() and a.isalnum()):
        return False
    return not b.isspace() and (not b.isalnum() or a.isdigit() != b.isdigit())


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}

    # one long match

    def _piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.plain._encode_single_piece(data)
        half = len(data) // 2
        return self._join_pieces(self._piece(data[:half]), self._piece(data[half:]))

    def _stable(self, a: int, b: int) -> bool:
        return self.plain._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._stable(left[-1], right[0]):
            return left + right
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            part = b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))
            middle = self.plain._encode_single_piece(part)
            if (a == 0 or self._stable(left[a - 1], middle[0])) and (b == len(right) or self._stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            k *= 2

    # text

    def _window(self, text: str) -> list[int]:
        """Ids of a text by its matches; only what a join encodes again or a leaf comes here."""
        if len(text) <= WIDE:
            return self.plain.encode_ordinary(text)
        out: list[int] = []
        for m in self.matches.finditer(text):
            out += self._piece(m.group().encode())
        return out

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text)) if text else []

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self.plain.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if safe_cut(text, mid):
            left.extend(right)
            return left
        a = b = None
        reach = 8
        while a is None or b is None:  # the window grows until what lies beyond each side is proved stable
            if a is None:
                a = next((i for i in range(mid - 1, max(lo, mid - reach), -1) if safe_cut(text, i)), lo if mid - reach <= lo else None)
            if b is None:
                b = next((i for i in range(mid + 1, min(hi, mid + reach)) if safe_cut(text, i)), hi if mid + reach >= hi else None)
            reach *= 2
        keep = self._tokens(left, len(text[a:mid].encode()), tail=True)
        drop = self._tokens(right, len(text[mid:b].encode()), tail=False)
        del left[len(left) - keep :]
        left.extend(self._window(text[a:b]))
        left.extend(right[drop:])
        return left

    def _tokens(self, ids: list[int], size: int, tail: bool) -> int:
        """How many tokens at an end of ``ids`` make up ``size`` bytes; a safe cut is always between tokens."""
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[-1 - n] if tail else ids[n]])
            n += 1
        if size:
            raise AssertionError("a safe cut inside a token")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[tuple[str, str], Bpe] = {}


def coder(path: str, pattern: str) -> Bpe:
    """The worker's coder of a rank file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Bpe(path, pattern)
    return _coders[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row's text."""
    at = _defaults(path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*at)
        for batch in batches:
            for part in sized(batch, "text"):
                ids = [bpe.encode(t) for t in texts_of(part, "text").to_pylist()]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row of ``encoded`` (a null array decodes to no bytes)."""
    at = _defaults(path, pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*at)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data = [bpe.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, decoded again, and digested in one task."""
    at = _defaults(path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*at)
        for batch in batches:
            for part in sized(batch, "text"):
                n, a, b = [], [], []
                for t in texts_of(part, "text").to_pylist():
                    ids = bpe.encode(t)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
