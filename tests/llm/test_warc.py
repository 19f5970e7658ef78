import base64
import glob
import gzip
import hashlib

from cipherlake.llm._frames import Workspace
from cipherlake.llm.warc import GAP, assemble, base32_sha1, capture_summary, parse_records, read_warc, write_warc


def round_trip(spark, pages, **more):
    ws = Workspace(spark, "warc-test")
    write_warc(pages, ws.path("a"), **more)
    return ws.path("a"), assemble(read_warc(spark, ws.path("a")))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.limit(7).selectExpr("page_id + 1000 AS page_id", "url", "html"))
    path, captures = round_trip(spark, pages)
    html = {r.page_id: r.html for r in pages.collect()}
    first = {}
    for k in sorted(html):
        first.setdefault(html[k], k)
    rows = capture_summary(captures).collect()
    assert sorted(r.page_id for r in rows) == sorted(html)
    for r in rows:
        t = html[r.page_id]
        revisit = first[t] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(t.encode()), digest(t))
        assert (r.record_type, r.refers_to) == (("revisit", first[t]) if revisit else ("response", None)) and r.has_request
    nested = {r.response.target_uri: r for r in captures.collect()}
    some = next(iter(nested.values()))
    assert some.request.text.startswith("GET ") and some.metadata.text.startswith("page-id: ") and some.response.http_header.startswith("HTTP/1.1 200")
    data = gzip.open(glob.glob(f"{path.removeprefix('file:')}/*.gz")[0]).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(GAP.encode())


def test_nasty_pages(spark):
    tricky = ["", None, "a", GAP, "x" + GAP, GAP + "x", "\r\n", "\r", "x\r\n\r", "WARC/1.1\r\nContent-Length: 0" + GAP + "WARC/1.1", "é漢🙂\x00", "y" * 200_000, "a", "", "\n" * 9]
    rows = [(k, None if k == 3 else f"http://h/{k} \r\nX", t, "clash", "clash") for k, t in enumerate(tricky)]
    rows += [(2, "u", "a", "", ""), (None, None, "a", "", ""), (None, "u", "only here", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type string")
    _, captures = round_trip(spark, pages)
    got = capture_summary(captures).collect()
    assert len(got) == len(rows)
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted((len((t or "").encode()), digest(t)) for _, _, t, *_ in rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {0, 2}
    payloads = sorted(bytes(r.response.payload) for r in captures.where("response.type = 'response'").collect())
    assert payloads[-1] == "é漢🙂\x00".encode() or payloads[-1] == b"y" * 200_000
    empty = pages.limit(0)
    assert capture_summary(round_trip(spark, empty)[1]).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc" * 9), (4, "u", "abc" * 9)], "page_id long, url string, html string")
    rows = {r.page_id: r.record_type for r in capture_summary(round_trip(spark, pages, min_bytes=10)[1]).collect()}
    assert rows == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_records_of_other_writers():
    """No metadata or request; several records; a block that ends within a gap."""
    blocks = [b"abc\r\n", b"", b"x\r\n\r\n", b"\r\n\r\n\r\n"]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in blocks)
    pieces = data.split(b"\r\n\r\n")
    pieces = pieces[:-1] if pieces[-1] == b"" else pieces
    assert [b for _, _, b in parse_records(("f", p) for p in pieces)] == blocks


def test_base32(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"", b"abc", b"\x00\xff" * 9)], "b binary")
    got = {bytes(r.b): r.d for r in df.select("b", base32_sha1(df.b).alias("d")).collect()}
    assert got == {k: base64.b32encode(hashlib.sha1(k).digest()).decode() for k in got}
