import base64
import gzip
import hashlib
import io

import duckdb
import pytest

from tracelink.llm import warc


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        to = max(same) if same and len(raw) >= least and max(same) != page_id else None
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ü x\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", ""), (4, "http://b", None), (4, "http://b", None), (5, "http://c", "\r\n\r\nWARC/1.1\r\n"), (None, "http://d", "<p>one</p>"), (None, "http://e", "alone"), (9, "http://f", "é" * 50_000), (6, "http://f", "é" * 50_000)]


@pytest.mark.parametrize("least", [0, 1, 11])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, seq int, file string")
    at = f"file://{tmp_path}/w"
    archives = warc.archive_pages(df, at, min_bytes=least, archive_bytes=200)
    got = warc.read_records(archives, at, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert not (tmp_path / "w/monolithic").exists()
    for f in (tmp_path / "w").glob("*.warc.gz"):  # still a gzip file as a whole
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Type") == sum(1 for _ in open(f"{f}.idx"))
    none = warc.archive_pages(df.limit(0), f"{at}0")
    assert warc.read_records(none, f"{at}0").count() == 0


def test_any_gzip_layout_and_broken_archives():
    one = warc.response(1, "http://a", b"x" * 100, "D", "2024-01-01T00:00:00Z")
    two = warc.response(2, "http://b", b"", "E", "2024-01-01T00:00:00Z")
    for raw in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(one[:50]) + gzip.compress(one[50:] + two)):
        out = io.BytesIO()
        places = list(warc.normalise_archive(io.BytesIO(raw), out))
        assert [gzip.decompress(out.getvalue()[a : a + n]) for _, a, n in places] != [] and len(places) == 2
        again = [warc.parse_record(*r)["page_id"] for r in warc.records(iter([gzip.decompress(out.getvalue())]))]
        assert again == [1, 2]
    for raw in (gzip.compress(one[:-10]), gzip.compress(one)[:-20], gzip.compress(b"nonsense\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.normalise_archive(io.BytesIO(raw), io.BytesIO()))


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(str, map(tuple, warc.op3_warc(spark, sf).collect()))) == sorted(map(str, con.execute(warc.OP3_SQL).fetchall()))
