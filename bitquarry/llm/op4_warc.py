"""Operator 4: WARC archives, written and read back by a splittable reader.

Every record is a gzip member of its own. The reader's tasks get byte ranges: they look for gzip's
magic bytes, take a candidate for a member only if it decodes to a WARC header, and own the records
that start inside their range, reading past its end for the last one.

Defined cases: a null payload is empty; of rows with equal payloads of at least ``least`` bytes, those
with the smallest page id (each of them, if it is repeated) are responses and the others revisits of
it, a null id counting as larger than all; a null or odd URL is written percent-encoded or left out;
an empty table gives no file and no row; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import filesystem, saved, shared_dir, sliced

MAGIC, PIECE = b"\x1f\x8b\x08", 1 << 16
#: Bytes after which a task begins another file, and of a range that one task reads.
FILE_BYTES, SPLIT_BYTES, LEVEL = 1 << 30, 16 << 20, 3
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = pa.schema([("uri", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit (without the payload) of the record of page ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url:
        safe = re.sub(rb"[\x00-\x20\x7f-\xff]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()
        headers.append(("WARC-Target-URI", safe))
    headers += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _member(headers, http + (payload if refers_to is None else b""))


def write_warc(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every row. Returns the manifest: uri, n_bytes, n_records.

    Equal payloads meet as digests and ids only: the smallest id of each repeated digest is summed
    up, written out, and joined to the ids; payloads move once, by page id.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("text"), F.sha2(payload, 256).alias("key"))
    ids = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = saved(ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first"), "warc-first")
    again = ids.join(first, "key").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "key", "first").distinct()
    both = rows.alias("r").join(again.alias("a"), F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.key") == F.col("a.key")), "left")
    both = both.select("r.page_id", "url", "text", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in sliced(batches, "text"):
            for page_id, url, text, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "text", "first")), strict=True):
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, n_records = fs.open_output_stream(path + ".part"), 0
                    info = b"software: bitquarry\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
                out.write(record(page_id, url, text.encode(), refers_to))
                n_records += 1
                if out.tell() >= FILE_BYTES:
                    yield _closed(out, fs, path, uri, n_records)
                    out = None
        if out is not None:
            yield _closed(out, fs, path, uri, n_records)

    return saved(both.mapInArrow(write, "uri string, n_bytes long, n_records long"), "warc-manifest")


def _closed(out, fs, path: str, uri: str, n_records: int) -> pa.RecordBatch:
    n = out.tell()
    out.close()
    fs.move(path + ".part", path)
    return pa.RecordBatch.from_pylist([{"uri": uri, "n_bytes": n, "n_records": n_records}], schema=_MANIFEST)


class _Range:
    """Bytes of a file from ``start`` on, read piece by piece as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, bytearray()
        self.file.seek(start)
        self.read = start

    def fill(self, to: int) -> None:
        """Hold the bytes up to file offset ``to``, or the end."""
        to = min(to, self.size)
        while self.read < to:
            got = self.file.read(max(PIECE, to - self.read))
            if not got:
                break
            self.data += got
            self.read += len(got)

    def forget(self, before: int) -> None:
        if before - self.at > 16 * PIECE:
            del self.data[: before - self.at]
            self.at = before

    def find(self, start: int, end: int) -> int:
        """First offset in [start, end) where magic bytes stand, or -1."""
        while start < end:
            stop = min(start + 16 * PIECE, end)
            self.fill(stop + len(MAGIC) - 1)
            got = self.data.find(MAGIC, start - self.at, min(stop + len(MAGIC) - 1, self.read) - self.at)
            if got >= 0:
                return got + self.at
            self.forget(stop)
            start = stop
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at an offset and the offset after it; None if it is no WARC record."""
        z, parts, valid = zlib.decompressobj(31), [], False
        while not z.eof:
            self.fill(at + PIECE)
            piece = bytes(self.data[at - self.at : at - self.at + PIECE])
            if not piece:
                return None
            try:
                parts.append(z.decompress(piece))
            except zlib.error:
                return None
            at += len(piece)
            if not valid:
                begun = b"".join(parts)[:7]
                if not b"WARC/1.".startswith(begun) :
                    return None
                valid = len(begun) == 7
        return (b"".join(parts), at - len(z.unused_data)) if valid else None


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end)."""
    window, at = _Range(file, start, size), start
    while (at := window.find(at, end)) >= 0:
        got = window.member(at)
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]
            window.forget(at)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return headers, rest[: int(headers.get("content-length", 0))]


def read_warc(manifest: DataFrame, split: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Response and revisit records: record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to (record id), and on demand payload.

    The manifest has a row for each file of up to a gigabyte; its ranges are listed on the driver.
    """
    spark = manifest.sparkSession
    ranges = [(r.uri, r.n_bytes, a, min(a + split, r.n_bytes)) for r in manifest.collect() for a in range(0, r.n_bytes, split)]
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)
    ddl = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for x in b.to_pylist():
                fs, path = filesystem(x["uri"])
                with fs.open_input_file(path) as f:
                    for data in members(f, x["size"], x["start"], x["end"]):
                        headers, block = parsed(data)
                        if headers.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        row = {"record_id": headers["warc-record-id"], "record_type": headers["warc-type"], "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
                        if row["record_type"] == "response":
                            row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload), "payload": payload}
                        else:
                            stated = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)
                            row |= {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:")}
                        rows.append(row)
                        held += len(payload) * payloads + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not ranges:
        return spark.createDataFrame([], ddl)
    return spark.createDataFrame(ranges, "uri string, size long, start long, end long").repartition(len(ranges)).mapInArrow(read, ddl)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return read_warc(manifest).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
