"""WARC archives: written, normalised to one gzip member per record, indexed, and read back.

1. ``write_archives`` writes a response record per page into monolithic gzip archives (one stream per
   file) and returns one slim row per record.
2. ``mark_revisits`` finds, from the slim rows, the records whose payload another record holds.
3. ``normalise`` inflates each monolithic archive once, front to back, rewrites every record as its own
   gzip member - repeated payloads as revisit records - and writes a sidecar offset index.
4. ``read_records`` reads each archive's index and inflates the records by their offsets.

Html is read once from the table and never shuffled; slim rows are shuffled by digest and by file.

Edge cases: a null payload is empty; a null url is written as ``urn:page:<page_id>``; control characters
of a url are percent-encoded; rows with the same page_id are records of their own, and if theirs is
the largest id of the payload all of them are responses; a record without a page_id is a revisit if
another record with an id has its payload; an empty table gives no archive and an empty result;
other columns are ignored. An archive that ends inside a record raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.llm.common import filesystem, sized, unique_name
from tracelink.session import remove, work_path

#: Archives are normalised by up to this many tasks; beyond it a task takes several.
MOST_TASKS = 50_000

LEVEL = 5
SLIM = "file string, seq long, page_id long, sha1 string, n_bytes long"
FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date, "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%") if url is not None else f"urn:page:{page_id}", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    return record(headers, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)


def revisit(headers: dict[str, str], body: bytes, refers_to: int) -> tuple[dict[str, str], bytes]:
    """The revisit record that stands for a response record: its HTTP header only."""
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    new = headers | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    return new, body[: body.index(b"\r\n\r\n") + 4]


def inflate(source: io.RawIOBase, block: int = 64 << 10) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in blocks."""
    z, started = zlib.decompressobj(31), False
    while data := source.read(block):
        while data:
            started = True
            if out := z.decompress(data):
                yield out
            data = z.unused_data
            if z.eof:
                z, started = zlib.decompressobj(31), False
    if started:
        raise ValueError("the archive ends inside a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an inflated stream; memory holds one record and one block."""
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        if block is not None:
            held.extend(block)
        return block is not None

    while held or more():
        seek = 0
        while (end := held.find(b"\r\n\r\n", seek)) < 0:
            seek = max(0, len(held) - 3)
            if not more():
                raise ValueError("the archive ends inside a record's header")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start with WARC/")
        headers = dict(line.partition(":")[::2] for line in lines[1:])
        headers = {k.strip(): v.strip() for k, v in headers.items()}
        begin, size = end + 4, int(headers.pop("Content-Length"))
        while len(held) < begin + size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield headers, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


def write_archives(pages: DataFrame, directory: str, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) into monolithic archives of about ``archive_bytes``; a slim row per record."""
    fields = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("sha1", pa.string()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(directory)
        name = out = z = None
        size = seq = 0
        for batch in batches:
            for part in sized(batch, "html"):
                rows = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if out is None:
                        store.create_dir(top, recursive=True)
                        name, z, size, seq = unique_name("pages", ".warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    payload = (html or "").encode()
                    sha1 = hashlib.sha1(payload)
                    raw = response(page_id, url, payload, base32(sha1.digest()), date)
                    out.write(z.compress(raw))
                    rows.append({"file": name, "seq": seq, "page_id": page_id, "sha1": sha1.hexdigest(), "n_bytes": len(payload)})
                    size, seq = size + len(raw), seq + 1
                    if size >= archive_bytes:
                        out.write(z.flush())
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
        if out is not None:
            out.write(z.flush())
            out.close()

    at = f"{directory}/records"
    pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, SLIM).write.parquet(at)
    return pages.sparkSession.read.parquet(at)


def mark_revisits(slim: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The slim rows with refers_to: the largest page_id of an equal payload of at least ``min_bytes``, or null.

    Payloads that occur once need no join; of the others the largest id is aggregated map-side, and the
    join may be split where one payload fills a large part of the table.
    """
    held = slim.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("holder")), None).otherwise(F.col("holder"))
    return slim.join(held.select("sha1", "holder"), "sha1", "left").select("file", "seq", "page_id", "n_bytes", refers.alias("refers_to"))


def normalise_archive(source: io.RawIOBase, target: io.RawIOBase, rewrite: Callable[[int, dict, bytes], tuple[dict, bytes]] | None = None) -> Iterator[tuple[dict, int, int]]:
    """Inflate ``source`` once and write each record to ``target`` as a gzip member of its own; yields headers, offset and length."""
    at = 0
    for seq, (headers, body) in enumerate(records(inflate(source))):
        if rewrite:
            headers, body = rewrite(seq, headers, body)
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(record(headers, body)) + z.flush()
        target.write(member)
        yield headers, at, len(member)
        at += len(member)


def normalise(marked: DataFrame, source: str, directory: str) -> DataFrame:
    """Normalise the archives of ``source`` into ``directory``; a row per archive: file, n_records, n_bytes.

    The index beside an archive (suffix .idx) has a line per record: offset, length, type, page id, digest.
    """
    fields = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def one(name: str, refers: dict[int, int]) -> dict:
        (a, top), (b, to) = filesystem(source), filesystem(directory)
        new = unique_name("records", ".warc.gz")
        b.create_dir(to, recursive=True)
        change = lambda seq, headers, body: revisit(headers, body, refers[seq]) if seq in refers else (headers, body)
        n = size = 0
        with a.open_input_stream(f"{top}/{name}", compression=None) as src, b.open_output_stream(f"{to}/{new}", compression=None) as out, b.open_output_stream(f"{to}/{new}.idx") as index:
            for headers, at, length in normalise_archive(src, out, change):
                index.write(f"{at}\t{length}\t{headers['WARC-Type']}\t{headers.get('X-Page-Id', '')}\t{headers.get('WARC-Payload-Digest', '')}\n".encode())
                n, size = n + 1, at + length
        return {"file": new, "n_records": n, "n_bytes": size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, refers = None, {}
        for batch in batches:
            for file, seq, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if name is not None:
                        yield pa.RecordBatch.from_pylist([one(name, refers)], schema=fields)
                    name, refers = file, {}
                if to is not None:
                    refers[seq] = to
        if name is not None:
            yield pa.RecordBatch.from_pylist([one(name, refers)], schema=fields)

    # archives are of one size, so they are dealt out one by one: a task inflates its share, however slim the rows it is told by
    names = marked.select("file").distinct()
    count = max(1, names.count())
    tasks = min(count, MOST_TASKS)
    order = names.withColumn("task", F.pmod(F.row_number().over(Window.orderBy("file")), F.lit(tasks)).cast("int"))
    dealt = marked.select("file", "seq", "refers_to").join(order, "file").repartitionById(tasks, F.col("task"))
    at = f"{directory}/archives"
    dealt.sortWithinPartitions("file", "seq").select("file", "seq", "refers_to").mapInArrow(run, "file string, n_records long, n_bytes long").write.parquet(at)
    return marked.sparkSession.read.parquet(at)


def read_index(store, path: str) -> list[tuple[int, int]]:
    with store.open_input_stream(f"{path}.idx") as f:
        return [(int(a), int(b)) for a, b, *_ in (line.split("\t") for line in f.read().decode().splitlines())]


def parse_record(headers: dict[str, str], body: bytes) -> dict:
    """What a stored record says; a response's size and digest are those of the payload read."""
    http, _, payload = body.partition(b"\r\n\r\n")
    row = {"page_id": int(headers["X-Page-Id"]) if "X-Page-Id" in headers else None, "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None}
    if row["record_type"] == "revisit":
        size = next(line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        return row | {"payload_bytes": int(size), "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}
    return row | {"payload_bytes": len(payload), "payload_digest": base32(hashlib.sha1(payload).digest()), "payload": payload}


def read_records(archives: DataFrame, directory: str, payload: bool = False, block: int = 8 << 20) -> DataFrame:
    """Every record of normalised archives, each inflated at its offset; with its payload if asked for."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(directory)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                places = read_index(store, f"{top}/{name}")
                with store.open_input_file(f"{top}/{name}") as f:
                    i = 0
                    while i < len(places):
                        j = i + 1
                        while j < len(places) and places[j][0] + places[j][1] - places[i][0] <= block:
                            j += 1
                        data = f.read_at(places[j - 1][0] + places[j - 1][1] - places[i][0], places[i][0])
                        rows = []
                        for at, length in places[i:j]:
                            at -= places[i][0]
                            (one,) = records(iter([zlib.decompress(data[at : at + length], 31)]))
                            rows.append(parse_record(*one))
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                        i = j

    n = max(1, archives.count())
    return archives.select("file").repartition(n).mapInArrow(read, FOUND + ", payload binary" * payload)


def archive_pages(pages: DataFrame, directory: str, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """All steps; the monolithic archives are deleted once they are normalised."""
    source = f"{directory}/monolithic"
    marked = mark_revisits(write_archives(pages, source, archive_bytes), min_bytes)
    archives = normalise(marked, source, directory)
    remove(pages.sparkSession, source)
    return archives


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written, normalised and read back."""
    directory = work_path(spark, "warc")
    archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), directory)
    return read_records(archives, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, max(page_id) AS m FROM p GROUP BY d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.d, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM p JOIN g USING (d)
"""
