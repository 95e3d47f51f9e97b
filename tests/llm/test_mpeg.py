import hashlib
import random
import struct
import zlib

from tracelink.llm import mpeg


def test_round_trip():
    for raw in (b"", b"a", b"x" * 192, "é汉😀".encode() * 300, bytes(range(256)) * 9, b"\xff\xfa" * 4000):
        data = mpeg.mux(mpeg.padded(raw))
        x = mpeg.probe(data)
        assert mpeg.demux(data, x["offsets"]) == mpeg.padded(raw)
        assert x["samples"] == 1152 * len(x["offsets"]) and x["rate"] == 48000 and x["skipped"] == 0
        assert x["table_agrees"] and x["crc_failed"] == 0 and x["crc_checked"] == len(x["offsets"])
        assert x["tags"]["TSSE"] == "tracelink"


def test_resynchronises_and_finds_bad_checksums():
    good = mpeg.mux(mpeg.padded(b"hello " * 900))
    x = mpeg.probe(good)
    a, b = x["offsets"][3], x["offsets"][7]
    junk = b"\xff\xfb\x00junk\xff\xff" * 5
    y = mpeg.probe(good[:a] + junk + good[a:b] + bytes([*good[b : b + 10], good[b + 10] ^ 1]) + good[b + 11 :] + b"TAG" + b"song".ljust(125, b"\0"))
    assert y["skipped"] == len(junk) and len(y["offsets"]) == len(x["offsets"])
    assert y["crc_failed"] == 1 and y["tags"]["title"] == "song" and y["table_agrees"] is False
    cut = mpeg.probe(good[:-10])
    assert len(cut["offsets"]) == len(x["offsets"]) - 1 and cut["skipped"] == 230


def test_random_bytes_never_fail():
    rng = random.Random(1)
    for _ in range(300):
        mpeg.probe(rng.randbytes(rng.randrange(0, 4000)))
    assert mpeg.probe(None)["rate"] is None and mpeg.probe(b"")["offsets"] == []


def test_sizes_of_all_headers():
    for first, version in ((True, 3), (False, 2), (False, 0)):
        for layer in (1, 2, 3):
            for bits in range(1, 15):
                for rate in range(3):
                    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | 1 << 16 | bits << 12 | rate << 10
                    h, kb, hz = mpeg.header(word), mpeg.BITRATES[first, layer][bits], mpeg.RATES[version][rate]
                    seconds = h.samples / hz
                    assert abs(h.size - kb * 1000 / 8 * seconds) < 4 and h.layer == layer


def test_vbri():
    frame = bytearray(mpeg.mux(mpeg.padded(b""))[-240:])
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 480, 1, 2, 1, 2, 1) + struct.pack(">HH", 240, 240)
    first = bytes(frame[:36]) + table + bytes(240 - 36 - len(table))
    x = mpeg.probe(first + bytes(frame))
    assert x["table"]["kind"] == "VBRI" and x["table"]["toc"] == [240, 240] and x["table_agrees"]


def test_cut_tables_and_tags_never_fail():
    """Every prefix of frames with a VBRI or Xing table and of tags, and tables that say more than there is."""
    rng = random.Random(4)
    small = next(w for w in (0x7FF << 21 | 2 << 19 | 1 << 17 | 1 << 16 | b << 12 | r << 10 | 3 << 6 for b in range(1, 15) for r in range(3)) if mpeg.header(w) and mpeg.header(w).size <= 52)
    size = mpeg.header(small).size
    for mark in (b"VBRI", b"Xing", b"Info"):
        for at in range(4, size - 3):
            frame = bytearray(small.to_bytes(4, "big") + rng.randbytes(size - 4))
            frame[at : at + 4] = mark
            for stop in range(size, 2 * size + 1):
                mpeg.probe((bytes(frame) * 2)[:stop])
    whole = mpeg.tag({"TIT2": "name", "TALB": "x" * 30}) + mpeg.mux(b"y" * 192)
    for stop in range(len(whole)):
        mpeg.probe(whole[:stop])
    for size in range(40):
        x = mpeg.probe(b"ID3\x03\0\0" + mpeg.synchsafe(size) + b"TIT2" + struct.pack(">IH", 200, 0) + b"\0abc")
        assert x["tags"].get("TIT2", "") in "abc"
    for _ in range(2000):
        raw = bytearray(whole[: rng.randrange(1, 400)])
        for _ in range(rng.randrange(6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        mpeg.probe(bytes(raw))


def test_table(spark):
    texts = ["", None, "a", "a", "é" * 20000, "x" * 192]
    df = spark.createDataFrame([(i if i else None, t, b"z", 3) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int")
    got = mpeg.probe_media(mpeg.to_media(df), payload=True).collect()
    for r in got:
        raw = (texts[r.doc_id or 0] or "").encode()
        body = mpeg.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
    assert len(got) == len(texts) and mpeg.probe_media(mpeg.to_media(df.limit(0))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in mpeg.op8_mpeg(spark, sf).collect():
        body = mpeg.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.media_sha256) == (len(docs[r.doc_id]), hashlib.sha256(body).hexdigest(), hashlib.sha256(mpeg.mux(body)).hexdigest())
        assert "crc=%d/%d;skipped=0" % ((len(body) // 192,) * 2) in r.feature and "table=Xing:true" in r.feature
