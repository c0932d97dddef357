"""WARC archives: writing with payload de-duplication, and a salvage reader.

Writing.  Every row is one record.  Among rows of equal payloads (of at least
``min_bytes``) the one with the smallest id is a ``response``, the others are
``revisit`` records that refer to it.  The records are written by Spark's text sink
with the record separator as its line separator, so the archives go to any
file system Spark can write, committed task by task.

Reading.  A file is checked record by record: version line, header fields, length,
separator, block digest and payload digest; members of compressed archives
must also pass their own checksum.  After a failed check the reader looks for
the next version line or compressed member that starts a wholly valid record,
goes on there, and logs the bytes between as a quarantined gap.

Defined results: null payload is an empty one; a null url gives a record without a
target; null ids sort after all others; rows that repeat id and payload are alike
(all of them responses if the id is the smallest); a file without any
valid record is one gap; an empty file has no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiframe.llm.common import materialise, release, scratch_path

SEPARATOR = "\r\n\r\n"
FILE_BYTES = 32 << 20  # mean size of an archive file
URN = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.|\x1f\x8b\x08")
_ID = re.compile(rf"<{URN}(.*)>\Z")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A record without its separator.  ``refers_to`` makes it a revisit, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


#: Bytes that a decompressor gets at a time: what follows a member is looked at no further.
MEMBER_PIECE = 1 << 16


class Damaged(Exception):
    """Why the bytes at a position are no valid record."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the position after it; raises Damaged."""
    if data.startswith(GZIP, at):
        member, view, stop, parts = zlib.decompressobj(31), memoryview(data), at, []
        try:
            while not member.eof and stop < len(data):
                parts.append(member.decompress(view[stop:stop + MEMBER_PIECE]))
                stop = min(stop + MEMBER_PIECE, len(data))
            inner = b"".join([*parts, member.flush()])
        except zlib.error as e:
            raise Damaged(f"compressed member: {e}") from None
        if not member.eof:
            raise Damaged("compressed member ends early")
        record, end = parse_record(inner, 0) if not inner.startswith(GZIP) else (None, -1)
        if end != len(inner):
            raise Damaged("compressed member holds more than a record")
        return record, stop - len(member.unused_data)
    if not (m := _VERSION.match(data, at)):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[m.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise Damaged("header line without a name")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Damaged("no length")
    begin = stop + 4
    end = begin + int(size)
    if end > len(data):
        raise Damaged("block ends early")
    if not data.startswith(b"\r\n\r\n", end):
        raise Damaged("no separator after the block")
    block = data[begin:end]
    kind = fields.get(b"warc-type")
    if not re.fullmatch("[a-z]+", kind or "") or b"warc-record-id" not in fields:
        raise Damaged("no type or id")
    if (own := fields.get(b"warc-block-digest")) and own != f"sha1:{digest(block)}":
        raise Damaged("block digest differs")
    payload = None
    if kind == "response":
        head, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise Damaged("response without a payload")
        if (own := fields.get(b"warc-payload-digest")) and own != f"sha1:{digest(payload)}":
            raise Damaged("payload digest differs")
    return {"fields": fields, "type": kind, "payload": payload}, end + 4


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of valid records, (start, end, None, reason) of gaps."""
    at, n = 0, len(data)
    while at < n:
        try:
            record, end = parse_record(data, at)
        except Damaged as e:
            start, reason, found = at, str(e), None
            for m in _START.finditer(data, at + 1):
                try:
                    found = parse_record(data, m.start())
                except Damaged:
                    continue
                at = m.start()
                break
            if not found:
                yield start, n, None, reason
                return
            yield start, at, None, reason
            record, end = found
        yield at, end, record, None
        at = end


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row to the folder ``path``."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= min_bytes, F.sha1(F.col("payload").cast("binary"))))
    same = rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    same = materialise(same.where("n > 1 and first is not null").select("sha", "first"), "payloads")
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    dealt = rows.join(same, "sha", "left").select(
        "id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("refers"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                rows = zip(*[c.to_pylist() for c in b.slice(i, 1000).columns])
                out = [encode_record(p, url, text.encode("utf-8"), refers) for p, url, text, refers in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    per_file = max(1, int(file_bytes / (mean + 700)))
    lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_file).text(path)
    release(same)


RECORD_COLUMNS = ("path string, start long, end long, reason string, type string, record_id string, target_uri string, "
                  "refers_to string, payload_bytes long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*") -> DataFrame:
    """Records and gaps: path, start, end; reason (gaps only); type, record_id, target_uri,
    refers_to, payload_bytes, payload_digest (declared for revisits) and payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    names = [x.split()[0] for x in RECORD_COLUMNS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own, rows, size = b.column(0)[i].as_py(), [], 0
                for start, end, record, reason in salvage(b.column(1)[i].as_py()):
                    if record is None:
                        rows.append((own, start, end, reason) + (None,) * 7)
                    else:
                        f, p = record["fields"], record["payload"]
                        declared = f.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((own, start, end, None, record["type"], f[b"warc-record-id"], f.get(b"warc-target-uri"), f.get(b"warc-refers-to"),
                                     None if p is None else len(p), declared if p is None else digest(p), p if payloads else None))
                    size += end - start
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(read, RECORD_COLUMNS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payload length of each revisit taken from the response it refers to."""
    found = records.where("type = 'response'").groupBy(F.col("record_id").alias("rid"), F.col("payload_digest").alias("rdigest")).agg(
        F.max("payload_bytes").alias("rbytes"))
    joined = records.join(found, (F.col("refers_to") == F.col("rid")) & (F.col("payload_digest") == F.col("rdigest")), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "rbytes")).drop("rid", "rdigest", "rbytes")


def op4_warc_salvage(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = materialise(read_archives(spark, path, payloads=False, pattern="part-*").where("reason is null"), "warc-records")
    number = lambda c: F.regexp_extract(c, f"<{URN}(-?[0-9]+)>", 1).try_cast("long")
    return resolve_revisits(records).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"))
