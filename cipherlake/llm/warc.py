"""WARC archives: writing captures, reading records, and assembling them into one row per capture."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

# Fixed values of the format.
VERSION = "WARC/1.1"
EOL = "\r\n"
#: Ends a record, and ends a record's header.
GAP = EOL + EOL
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: four groups of 40 bits, in conv's digits, renamed."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _DIGITS32, BASE32)


def _record(kind: str, uid: Column, fields: list[Column], block: Column) -> Column:
    """One record's bytes up to its closing gap: header lines, the gap, the block."""
    head = F.concat_ws(
        EOL,
        F.lit(VERSION),
        F.lit(f"WARC-Type: {kind}") if kind != "response" else F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), uid, F.lit(">")),
        *fields,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head.cast("binary"), F.lit(GAP).cast("binary"), block.cast("binary"))


def decide_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to (page_id, url, payload).

    Equal payloads are found by SHA-256 over rows without payloads; of payloads of at least `min_bytes`, the one with
    the smallest page_id is a response. A hot payload's rows are pre-aggregated before the shuffle.
    """
    keyed = pages.withColumn("content", F.unhex(F.sha2("payload", 256)))
    first = keyed.groupBy("content").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # Written first: the join then has two plain shuffles, of which adaptive execution can split a hot payload's part.
    first = Workspace(pages.sparkSession, "warc-copies").save(first.where("copies > 1"), "first")
    joined = keyed.join(first, "content", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & (F.col("first_id") < F.col("page_id"))
    revisit = F.coalesce(revisit | (F.col("first_id").isNotNull() & F.col("page_id").isNull()), F.lit(False))
    return joined.select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes each page as a request, a response or revisit, and a metadata record, in gzipped archives under `path`.

    Spark's text writer lays the records out: each row is one record and the line separator is the format's closing
    gap, so archives go to any file system Spark knows, one per task. The three records of a capture are explode()d
    from one row and refer to the response through WARC-Concurrent-To. Record ids hold the capture's own id, made of
    the row's place in the input, so repeated page ids stay apart.

    Null html is an empty payload; a null url is an empty URI; a null page id is written as an empty field and, among
    equal payloads, always a revisit if another row has an id. Rows that repeat both id and payload are written as
    the first of them is.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.regexp_replace(text_or_empty(url_col), "[\\x00-\\x20]", "").alias("url"),
        text_or_empty(html_col).cast("binary").alias("payload"),
    )
    rows = decide_revisits(rows, min_bytes).withColumn("rid", F.monotonically_increasing_id())
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uid = lambda kind: F.concat(F.lit("urn:capture:"), page, F.lit(":"), F.col("rid").cast("string"), F.lit(f":{kind}"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    stamp = F.lit(f"WARC-Date: {date}")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), uid("response"), F.lit(">"))
    request = _record("request", uid("request"), [target, stamp, concurrent, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{GAP}")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP)).cast("binary")
    again = F.col("record_type") == "revisit"
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    response = _record(
        "response",
        uid("response"),
        [
            target,
            stamp,
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
            F.when(again, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
            F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:capture:"), F.col("refers_to").cast("string"), F.lit("::response>"))),
            F.lit("Content-Type: application/http; msgtype=response"),
        ],
        body,
    )
    metadata = _record("metadata", uid("metadata"), [target, stamp, concurrent, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("page-id: "), page, F.lit(f"{EOL}payload-length: "), F.col("payload_bytes").cast("string"), F.lit(EOL)))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("record")).select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", GAP).option("compression", "gzip").text(path)


def parse_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(file, header, block) of each record, from (file, piece) in file order, where pieces are what the gaps separate.

    The pieces are joined by gaps again and cut by Content-Length, as blocks may hold gaps or end within one.
    """
    gap = GAP.encode()
    file, head, buffer = None, None, bytearray()
    for source, piece in pieces:
        if source != file:
            if head is not None or buffer.strip():
                raise ValueError(f"{file} ends within a record")
            file, buffer = source, bytearray()
        buffer += piece
        buffer += gap
        while True:
            if head is None:
                stop = buffer.find(gap)
                if stop < 0 or not buffer.strip():
                    break
                lines = buffer[:stop].decode("utf-8", "replace").split(EOL)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record where one is due in {file}")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                del buffer[: stop + len(gap)]
            want = int(head["content-length"])
            if len(buffer) < want + len(gap):
                break
            if buffer[want : want + len(gap)] != gap:
                raise ValueError(f"Content-Length is wrong in {file}")
            yield file, head, bytes(buffer[:want])
            del buffer[: want + len(gap)]
            head = None
    if head is not None or buffer.strip():
        raise ValueError(f"{file} ends within a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records under `path`: type, record_id, concurrent_to, refers_to, target_uri, date, payload_digest, content_type, block.

    The text reader streams each gzipped archive in order within one task, cut at the gaps; archives of any size need
    the memory of their longest record only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                yield from zip(column(batch, "file").to_pylist(), column(batch, "piece").to_pylist(), strict=True)

        out: list[tuple] = []
        size = 0
        for _, head, block in parse_records(pieces()):
            out.append((*(head.get(f) for f in fields), block))
            size += len(block)
            if size > 4 << 20 or len(out) >= 2000:
                yield as_batch(out)
                out, size = [], 0
        if out:
            yield as_batch(out)

    fields = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type"]
    names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "content_type", "block"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(fields) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ship_package(spark)
    lines = spark.read.option("lineSep", GAP).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return rows.mapInArrow(run, ", ".join(f"{n} string" for n in names[:-1]) + ", block binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null where the archive has none).

    Requests and metadata records are joined to the response or revisit that their concurrent-to names. These two kinds
    are small, so they are written once, and the archives are read twice, not once for each kind.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    split = F.expr("locate(unhex('0D0A0D0A'), block)")
    response = F.struct(
        "type", "target_uri", "date", "payload_digest", "refers_to",
        F.expr("substring(block, 1, locate(unhex('0D0A0D0A'), block) - 1)").cast("string").alias("http_header"),
        F.when(split > 0, F.expr("substring(block, locate(unhex('0D0A0D0A'), block) + 4)")).otherwise(F.col("block")).alias("payload"),
    )
    out = main.select(F.col("record_id").alias("capture_id"), response.alias("response"))
    small = records.where(F.col("type").isin("request", "metadata")).select("type", "record_id", "concurrent_to", "content_type", "block")
    small = Workspace(records.sparkSession, "warc-sides").save(small, "sides")
    for kind in ("request", "metadata"):
        side = small.where(F.col("type") == kind).select(
            F.col("concurrent_to").alias(f"{kind}_of"), F.struct("record_id", "content_type", F.col("block").cast("string").alias("text")).alias(kind)
        )
        out = out.join(side, F.col("capture_id") == F.col(f"{kind}_of"), "left").drop(f"{kind}_of")
    return out


def capture_summary(captures: DataFrame) -> DataFrame:
    """The contract's columns, all from what the archives hold."""
    field = lambda name: F.regexp_extract("metadata.text", f"(?m)^{name}: ?(.*?)\\r?$", 1)
    payload = F.col("response.payload")
    revisit = F.col("response.type") == "revisit"
    stated = F.regexp_replace("response.payload_digest", "^sha1:", "")
    return captures.select(
        F.nullif(field("page-id"), F.lit("")).cast("long").alias("page_id"),
        F.when(revisit, field("payload-length").cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(base32_sha1(payload)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.regexp_extract("response.refers_to", "^<urn:capture:(-?[0-9]+):", 1).cast("long")).alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").isNotNull().alias("has_request"),
    )
