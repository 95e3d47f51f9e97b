import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tracelink.llm import token_counts, token_ids

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b ", "\n\n a\t b", "it's 12ab34  <|endoftext|> x", "naïve  b　 c  d", "▁ a▁b ▁▁ c", "x\x00 y", "\x00", "<s> </s>",
    "汉字 漢字。 かな", "😀 😀😀 ‍", "a" * 3000 + " " + "bc" * 50, "same text", "same text", "é ́ a\x85 b\x1c c", " " * 70 + "x", "﻿ a",
]


def frame(spark, texts=TEXTS):
    rows = [(i if i != 5 else None, t, 7, "z") for i, t in enumerate(texts)] + [(3, "twice", 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, frame string")


def test_token_ids_round_trip(spark, tmp_path):
    df = frame(spark)
    at = f"file://{tmp_path}/shards"
    token_ids.write_shards(df, at, shard_bytes=300)
    got = token_ids.read_shards(spark, at, ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in df.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted((r.doc_id is not None and r.doc_id) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted(x.tolist() for x in token_ids.read_document(spark, at, 3)) == sorted(list(r.ids) for r in got if r.doc_id == 3)


def test_token_ids_empty(spark, tmp_path):
    at = f"file://{tmp_path}/none"
    token_ids.write_shards(frame(spark).limit(0), at)
    assert token_ids.read_shards(spark, at).count() == 0


def test_token_counts(spark):
    df = frame(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for size in (0, 5, 1000):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, limit=20, table_size=size).collect())
        want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 20) for r in df.collect())
        assert got == want
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, sf).collect()} == {k: len(x) for k, x in zip(docs, sp.encode(list(docs.values())), strict=True)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array([*e.ids, 2], "<u4") for k, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    got = {r.doc_id: r for r in token_ids.op1_token_ids(spark, sf).collect()}
    start = 0
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])


def test_tokenizer_that_must_not_be_cut():
    """A tokenizer that normalises and drops white space gets whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Two  words\u3000HERE", "", " a  b ", "e\u0301 <|endoftext|> x", "long " * 3000]
    got = token_ids.encode_texts(pa.array(texts, pa.large_string()), path, 2)
    assert [x.tolist() for x in got] == [[*e.ids, 2] for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_length_table():
    words = [f"w{i}" for i in range(5000)]
    table = token_counts.LengthTable(words, np.arange(5000))
    asked = pa.array([*words[::-1], "other", "", "w5000"], pa.large_string())
    assert table(asked).tolist() == [*range(4999, -1, -1), -1, -1, -1]
    assert token_counts.LengthTable([], np.zeros(0, np.int64))(asked[:2]).tolist() == [-1, -1]
