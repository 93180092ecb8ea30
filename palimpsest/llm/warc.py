"""WARC archives: write, read back, resolve revisits by payload digest, write deduplicated archives.

Records are built as strings by Spark and written by Spark's text writer (gzip), so archives go wherever the session can
write and a lost task is simply written again.  Files hold a bounded number of records, set from the measured mean, and large
pages stand alone in files of their own, so that a reader may take a file whole.  Only headers are shuffled by digest; payloads stay where they are
and meet their decisions file by file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, setting, tidied, written

_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
FILE_BYTES, LARGE_BYTES = 8 << 20, 256 << 10
BROADCAST_BYTES = 16 << 20
HEADER_SCHEMA = "file string, at bigint, page_id bigint, url string, type string, record_id string, payload_digest string, payload_bytes bigint, refers_at string, refers_page bigint"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 of a payload's SHA-1, from its hex digits five at a time."""
    hexed = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), _DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends inside the value are dropped."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]", ""), F.lit("\r\n")), F.lit(""))


def _record(kind: Column, payload: Column, extra: Column, date: str, salt: str) -> Column:
    """One record without the blank lines that end it; the columns page_id, url and payload_digest name the rest."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(kind == "response", _line("Content-Length", F.octet_length(payload))).otherwise(""), F.lit("\r\n"))
    block = F.concat(http, payload)
    raw = F.md5(F.concat_ws("|", F.lit(salt), F.col("page_id").cast("string"), "url", "payload_digest", F.monotonically_increasing_id().cast("string")))
    uid = F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), extra, _line("Page-Id", F.col("page_id")), F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: str = "DEFAULT_COMPRESSION") -> None:
    """A response record per page, payload the html in UTF-8 (null: empty)."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    length, large = F.octet_length("payload"), F.octet_length("payload") > LARGE_BYTES
    size = rows.agg(F.avg(F.when(~large, length)).alias("mean"), F.count(F.when(large, 1)).alias("large")).first()
    each = max(1, int(FILE_BYTES / ((size["mean"] or 0) + 1000)))
    for part, most in ((~large, each), (large, 1))[: 2 if size["large"] else 1]:
        record = _record(F.lit("response"), F.col("payload"), F.lit(""), date, f"source{most}")
        digested = rows.where(part).withColumn("payload_digest", base32_sha1(F.col("payload")))
        digested.select(record.alias("value")).write.mode("append").options(**_written(level)).option("maxRecordsPerFile", most).text(path)


def _written(level: str) -> dict[str, str]:
    """Options of the text writer; level is a zlib level as Hadoop names it (BEST_SPEED, DEFAULT_COMPRESSION, NINE, ...)."""
    return {"compression": "gzip", "lineSep": _END, "zlib.compress.level": level}


def _inflate(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], int, int]]:
    """Offset, headers, and the start and end of the block of each record; raises on a malformed one."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, fields, start, end
        at = end + 4


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _header(file: str, data: bytes) -> pa.RecordBatch:
    """Headers of a file's records by HEADER_SCHEMA; digest and length of responses are taken from the payload itself."""
    rows = []
    for at, f, start, end in parse(data):
        payload = data.index(b"\r\n\r\n", start) + 4
        got, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), end - payload
        if f["WARC-Type"] == "response":
            own = base64.b32encode(hashlib.sha1(memoryview(data)[payload:end]).digest()).decode()
            if own != got:
                raise ValueError(f"payload at byte {at} of {file} has digest {own}, not {got}")
        else:
            size = int(f["Payload-Length"])
        rows.append((file, at, _number(f.get("Page-Id")), f.get("WARC-Target-URI"), f["WARC-Type"], f["WARC-Record-ID"], got, size, f.get("WARC-Refers-To"), _number(f.get("Refers-To-Page-Id"))))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in HEADER_SCHEMA.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/*.gz").select(F.col("path").alias("file"), "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header of every record of the archives below path (HEADER_SCHEMA), with payload digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                yield _header(file.as_py(), _inflate(content.as_py()))

    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        return written(_files(spark, path).mapInArrow(tidied(run), HEADER_SCHEMA), "headers")


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers with original (a struct of page_id, url and record_id): null for a record that stays a response.

    Of the records with one digest and at least ``least_bytes`` of payload the one with the smallest page id stays (ties and
    null ids: the first in file order); the others revisit it.
    """
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("file"), F.col("at"))
    first = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min_by(F.struct("page_id", "url", "record_id", "file", "at"), order).alias("original"))
    same = (F.col("original.file") == F.col("file")) & (F.col("original.at") == F.col("at"))
    return headers.join(first, "payload_digest", "left").withColumn("original", F.when((F.col("payload_bytes") >= least_bytes) & ~same, F.col("original")))


def write_deduplicated(spark: SparkSession, source: str, resolved: DataFrame, path: str, date: str = "2024-01-02T00:00:00Z", level: str = "DEFAULT_COMPRESSION") -> None:
    """The archives at source written anew: responses with their payload, revisits as headers that name the original."""
    packed = written(
        resolved.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "page_id", "url", "payload_digest", "payload_bytes", F.col("original.page_id").alias("to_page"), F.col("original.url").alias("to_url"), F.col("original.record_id").alias("to_id")))).alias("records")),
        "decisions",
    )  # a file has a bounded number of records
    total = packed.agg(F.sum(F.size("records") * 250)).first()[0] or 0
    side = F.broadcast(packed) if total <= BROADCAST_BYTES else packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, records in zip(batch.column(0), batch.column(1)):
                data = _inflate(content.as_py())
                blocks = {at: (start, end) for at, _, start, end in parse(data)}
                rows = records.values
                payloads = []
                for at, to in zip(rows.field("at").to_pylist(), rows.field("to_id").to_pylist()):
                    start, end = blocks[at]
                    payloads.append("" if to else data[data.index(b"\r\n\r\n", start) + 4 : end].decode())
                names = ["page_id", "url", "payload_digest", "payload_bytes", "to_page", "to_url", "to_id"]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([*[rows.field(n).slice(i, 256) for n in names], pa.array(payloads[i : i + 256], pa.string())], names=[*names, "payload"])

    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        rows = _files(spark, source).join(side, "file").select("content", "records").mapInArrow(tidied(run), "page_id bigint, url string, payload_digest string, payload_bytes bigint, to_page bigint, to_url string, to_id string, payload string")
        revisit = F.col("to_id").isNotNull()
        extra = F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To", F.col("to_id")), _line("WARC-Refers-To-Target-URI", F.col("to_url")),
            _line("Refers-To-Page-Id", F.col("to_page")), _line("Payload-Length", F.col("payload_bytes")),
        )).otherwise("")
        record = _record(F.when(revisit, "revisit").otherwise("response"), F.col("payload"), extra, date, "deduplicated")
        rows.select(record.alias("value")).write.options(**_written(level)).text(path)


def deduplicate(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of the pages, deduplicated archives beside them, and the headers of the latter read back (HEADER_SCHEMA).

    Null html is an empty payload, a null url has no target line, a null id stays null.  Repeated rows are records of their
    own, of which the first in file order is the response.  Empty tables give no record.  Other columns are not read.
    """
    spark = pages.sparkSession
    source, target = scratch(spark, "warc-source"), scratch(spark, "warc-deduplicated")
    write_archives(pages, source, id_col=id_col, url_col=url_col, html_col=html_col, level="BEST_SPEED")  # read twice, then of no use
    resolved = resolve_revisits(read_headers(spark, source), least_bytes)
    write_deduplicated(spark, source, resolved, target)
    return read_headers(spark, target)
