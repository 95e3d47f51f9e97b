import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelink.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.Bpe(PATH)
PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", "1", "23", "é", "汉字", "!?", "...", "\t", "　", "\xa0", "😀", "re", "ve", "ing", "-", "A", "x" * 40, "=" * 30, " " * 20]


def small(monkeypatch):
    for name, n in (("LEAF_CHARS", 5), ("LEAF_BYTES", 6), ("LEAF_TOKENS", 3), ("WIDE", 12)):
        monkeypatch.setattr(bpe, name, n)


def check(text):
    ids = CODER.encode(text)
    assert ids == CODER.plain.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


def test_random_texts(monkeypatch):
    small(monkeypatch)
    rng = random.Random(5)
    for _ in range(3000):
        check("".join(rng.choices(PARTS, k=rng.randrange(0, 40))))
    for n in (100, 1000, 5000):
        check("".join(rng.choices("abcdefghijklmnop", k=n)))
        check("ab" * n), check(" " * n), check("=" * n + "a"), check("汉" * n)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    sizes = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.WIDE
    bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.WIDE = 4, 4, 6
    try:
        check(text)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.WIDE = sizes


def test_table(spark):
    texts = ["", None, "a b", "a b", "word " * 4000, "汉" * 9000, "<|endoftext|>"]
    df = spark.createDataFrame([(i if i else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    want = {}
    for r in df.collect():
        ids = CODER.plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()} == want
    back = bpe.decode_documents(bpe.encode_documents(df))
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert bpe.digests(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.ids_sha256 for r in bpe.op7_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(np.array(CODER.plain.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()
