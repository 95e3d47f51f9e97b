"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``probe`` reads any MPEG 1, 2 or 2.5 stream of layers I to III. Frames are walked by their headers; where
a header is not valid, the reader searches for the next place where a valid header is followed by
another of the same version, layer and rate (or ends the stream), and counts what it skipped.
Leading ID3v2 and trailing ID3v1 tags are parsed, Xing/Info and VBRI tables are read and held
against the frames found, and layer III checksums are verified. Durations are exact: samples and rate.

``mux`` stores bytes as main data of layer III frames, 192 in each (48 kHz, mono, protected), behind an
ID3v2 tag and a Xing frame; ``demux`` reads them back. Frames whose bytes are all ASCII take 80
kbit/s, others 96: a variable-bitrate stream.

Edge cases: a null text is empty and is stored as one block of 192 blanks; a null or empty stream
has 0 frames and null rate; repeated rows give repeated rows; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelink.llm.common import sized, texts_of
from tracelink.session import written

BLOCK = 192
SIDE = 17
RATE = 48_000

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1 or not, layer), and Hz.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


class Header:
    """A frame header: size in bytes, samples, rate, layer, and where the main data begins."""

    __slots__ = ("alike", "layer", "protected", "rate", "samples", "side", "size")

    def __init__(self, size, samples, rate, layer, protected, side, alike) -> None:
        self.size, self.samples, self.rate, self.layer, self.protected, self.side, self.alike = size, samples, rate, layer, protected, side, alike


@lru_cache(maxsize=65_536)
def header(word: int) -> Header | None:
    """The header that a big-endian 32-bit word holds, or None. Free-format frames are not read."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bits, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    first = version == 3
    kbits, hz, pad = BITRATES[first, layer][bits], RATES[version][rate], word >> 9 & 1
    if layer == 1:
        size, samples = (12_000 * kbits // hz + pad) * 4, 384
    else:
        samples = 1152 if first or layer == 2 else 576
        size = samples // 8 * 1000 * kbits // hz + pad
    mono = word >> 6 & 3 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header(size, samples, hz, layer, not word >> 16 & 1, side if layer == 3 else 0, (version, layer, rate))


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    """CRC-16 of polynomial 0x8005 and start 0xFFFF, as frames carry it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def side_info(bits: int) -> bytes:
    """Mono side information that gives both granules ``bits`` bits of main data each, none kept back."""
    granule = bits << 47  # 12 of 59 bits
    return (granule << 59 | granule).to_bytes(SIDE, "big")


def main_bits(side: bytes) -> int:
    """Bits of main data that a mono MPEG 1 frame's side information announces."""
    value = int.from_bytes(side, "big")
    return (value >> 106 & 0xFFF) + (value >> 47 & 0xFFF)


SIDE_INFO = side_info(BLOCK * 4)


def _head(kbits: int) -> bytes:
    word = 0xFFFA_0000 | BITRATES[True, 3].index(kbits) << 12 | 1 << 10 | 3 << 6
    raw = word.to_bytes(4, "big")
    return raw + crc16(raw[2:] + SIDE_INFO).to_bytes(2, "big") + SIDE_INFO


HEADS = np.frombuffer(_head(80) + _head(96), np.uint8).reshape(2, -1)
SIZES = np.array([80, 96]) * 144 // 48
XING = (0xFFFB_0000 | BITRATES[True, 3].index(80) << 12 | 1 << 10 | 3 << 6).to_bytes(4, "big")


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of Latin-1 text fields."""
    body = b"".join(k.encode() + struct.pack(">IH", len(v) + 1, 0) + b"\0" + v.encode("latin-1") for k, v in fields.items())
    return b"ID3\x03\0\0" + synchsafe(len(body)) + body


def mux(payload: bytes) -> bytes:
    """A stream whose frames hold ``payload``, a positive multiple of 192 bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    wide = (blocks >= 128).any(axis=1).astype(np.int64)
    sizes = SIZES[wide]
    ends = np.cumsum(sizes)
    frames = np.zeros(int(ends[-1]), np.uint8)
    frames[(ends - sizes)[:, None] + np.arange(HEADS.shape[1] + BLOCK)] = np.hstack([HEADS[wide], blocks])
    total = int(SIZES[0] + ends[-1])
    # seek table: for each hundredth of the duration, the 256th of the bytes reached
    at = np.concatenate([[SIZES[0]], SIZES[0] + ends])[(np.arange(100) * len(blocks)) // 100]
    toc = np.minimum(255, at * 256 // total).astype(np.uint8).tobytes()
    table = (XING + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(blocks), total) + toc).ljust(int(SIZES[0]), b"\0")
    return tag({"TLEN": str(len(blocks) * 1152 * 1000 // RATE), "TSSE": "tracelink"}) + table + frames.tobytes()


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text fields, first byte after leading tags, and end of the frames' part."""
    fields: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags = data[at + 3], data[at + 5]
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        i, stop = at + 10, min(len(data), at + 10 + size)
        while major in (3, 4) and i + 10 <= stop and data[i] >= 48:
            raw = data[i + 4 : i + 8]
            n = struct.unpack(">I", raw)[0] if major == 3 else sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))
            if data[i] == ord("T") and n and i + 10 < stop:  # a frame cut off by the tag's end is read up to there
                codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[i + 10], "utf-8")
                fields[data[i : i + 4].decode("latin-1")] = data[i + 11 : min(stop, i + 10 + n)].decode(codec, "replace").rstrip("\0")
            i += 10 + n
        at = at + 10 + size + 10 * bool(flags & 16)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                fields.setdefault(name, value)
    return fields, at, end


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table of the frame at ``at``, if it has one."""
    for mark in (at + 4 + h.side, at + 6 + h.side):
        if data[mark : mark + 4] in (b"Xing", b"Info") and mark + 8 <= len(data):
            flags, i, out = struct.unpack(">I", data[mark + 4 : mark + 8])[0], mark + 8, {"kind": data[mark : mark + 4].decode()}
            for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    out[key] = data[i : i + size] if key == "toc" else int.from_bytes(data[i : i + size], "big")
                    i += size
            return out
    mark = at + 36
    if data[mark : mark + 4] == b"VBRI" and mark + 26 <= len(data):
        size, frames = struct.unpack(">II", data[mark + 10 : mark + 18])
        entries, scale, width, per = struct.unpack(">HHHH", data[mark + 18 : mark + 26])
        toc = [int.from_bytes(data[mark + 26 + k * width : mark + 26 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return None


def probe(data: bytes | None) -> dict:
    """What a stream holds: frames' offsets, samples, rate, tags, table, checksums, skipped bytes."""
    data = data or b""
    fields, at, end = _tags(data)
    out = {"tags": fields, "table": None, "offsets": [], "samples": 0, "rate": None, "crc_checked": 0, "crc_failed": 0, "skipped": 0}
    word = lambda i: header(int.from_bytes(data[i : i + 4], "big")) if i + 4 <= end else None
    alike, first = None, True
    while at + 4 <= end:
        h = word(at)
        if h is None or alike not in (None, h.alike) or at + h.size > end:
            h = None
        elif alike is None or first:
            follows = word(at + h.size)
            if at + h.size != end and (follows is None or follows.alike != h.alike):
                h = None
        if h is None:  # resynchronise
            i = at + 1
            while (i := data.find(b"\xff", i, end)) >= 0:
                x = word(i)
                if x and alike in (None, x.alike) and i + x.size <= end and (i + x.size == end or ((y := word(i + x.size)) and y.alike == x.alike)):
                    break
                i += 1
            i = end if i < 0 else i
            out["skipped"] += i - at
            at = i
            continue
        if first and (table := _table(data, at, h)):
            out["table"] = table | {"at": at}
        else:
            if h.protected and h.layer == 3:
                out["crc_checked"] += 1
                out["crc_failed"] += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
            out["offsets"].append(at)
            out["samples"] += h.samples
        alike, first, out["rate"] = h.alike, False, h.rate
        at += h.size
    out["skipped"] += max(0, end - at)
    table = out["table"]
    out["table_agrees"] = None if table is None else table.get("frames") == len(out["offsets"]) and table.get("bytes") in (None, end - table["at"])
    return out


def demux(data: bytes, offsets: list[int]) -> bytes:
    """The main data of mono MPEG 1 layer III frames, as their side information delimits it."""
    raw = memoryview(data)
    out = []
    for at in offsets:
        begin = at + 4 + 2 * (not data[at + 1] & 1)
        out.append(raw[begin + SIDE : begin + SIDE + main_bits_of(bytes(raw[begin : begin + SIDE])) // 8])
    return b"".join(out)


main_bits_of = lru_cache(maxsize=4096)(main_bits)


def padded(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stream that stores the padded text) of every row."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                raw = [x.as_py() for x in texts_of(part, "text").cast(pa.large_binary())]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


PROBED = "n_frames long, n_samples long, rate int, duration_us long, offsets array<long>, tags map<string,string>, table_kind string, table_agrees boolean, crc_checked long, crc_failed long, skipped_bytes long"


def probe_media(media: DataFrame, payload: bool = False) -> DataFrame:
    """Every row's key columns (all but media) with what ``probe`` finds, and the payload's digests if asked for."""
    keys = [c for c in media.columns if c != "media"]
    own = media.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    extra = ", media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long" if payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "media"):
                rows = []
                for data in part.column("media").to_pylist():
                    x = probe(data)
                    row = {"n_frames": len(x["offsets"]), "n_samples": x["samples"], "rate": x["rate"], "duration_us": x["samples"] * 1_000_000 // x["rate"] if x["rate"] else None, "offsets": x["offsets"], "tags": list(x["tags"].items()), "table_kind": (x["table"] or {}).get("kind"), "table_agrees": x["table_agrees"], "crc_checked": x["crc_checked"], "crc_failed": x["crc_failed"], "skipped_bytes": x["skipped"]}
                    if payload:
                        body = demux(data or b"", x["offsets"])
                        row |= {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest(), "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-16:])}
                    rows.append(row)
                kinds = [("n_frames", pa.int64()), ("n_samples", pa.int64()), ("rate", pa.int32()), ("duration_us", pa.int64()), ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("table_kind", pa.string()), ("table_agrees", pa.bool_()), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped_bytes", pa.int64())]
                if payload:
                    kinds += [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
                cols = [pa.array([r[k] for r in rows], t) for k, t in kinds]
                yield pa.record_batch([part.column(k) for k in keys] + cols, names=[*keys, *(k for k, _ in kinds)])

    return media.select(*keys, "media").mapInArrow(read, f"{own}, {PROBED}{extra}")


def op8_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG stream, read back from the stored table and digested."""
    media = written(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", compression="zstd")
    found = probe_media(media, payload=True)
    feature = "concat_ws(';', 'mpeg1-layer3', concat('frames=', n_frames), concat('samples=', n_samples), concat('rate=', rate), concat('us=', duration_us), concat('table=', table_kind, ':', table_agrees), concat('crc=', crc_checked - crc_failed, '/', crc_checked), concat('skipped=', skipped_bytes), concat('seek=', crc32(cast(array_join(offsets, ',') as binary))))"
    return found.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", f"{feature} AS feature")
