"""Writes pages as WARC archives and reads archives back, record by record.

Each record is a gzip member of its own. The reader takes an archive as a stream:
it inflates piece by piece, ends a record where its member ends, frames the block by
its content length and checks the digests of block and payload as they pass. It
holds one piece and one header, and a payload only if that is asked for.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import measured, new_folder, settle

DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 16
MAX_HEADER = 1 << 20
#: Fixed value: the profile of revisits of equal payloads.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _field(value: str) -> str:
    """A header value on one line: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response or revisit record as a gzip member. A revisit's block ends before the payload, whose length its HTTP header keeps."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    payload_digest = base32(hashlib.sha1(payload).digest())
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


class RecordParser:
    """Takes the inflated bytes of one record, in pieces of any size."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.fields, self.left = keep_payload, b"", None, 0
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.http, self.http_fields, self.payload_bytes, self.kept, self.tail = b"", None, 0, [], b""

    @staticmethod
    def _fields(raw: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                if len(self.head) > MAX_HEADER:
                    raise ValueError("header without an end")
                return
            if not self.head.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            self.fields, data, self.head = self._fields(self.head[:end]), self.head[end + 4 :], b""
            if not self.fields.get("content-length", "").isdigit():
                raise ValueError("no content length")
            self.left = int(self.fields["content-length"])
        part = data[: self.left]
        self.left -= len(part)
        self.tail += data[len(part) :]
        if len(self.tail) > 4:
            raise ValueError("more bytes than the content length")
        if part:
            self.block.update(part)
            self._entity(part)

    def _entity(self, part: bytes) -> None:
        """Split a block of HTTP into its header and the payload; any other block is payload."""
        if self.http_fields is None:
            if "application/http" not in self.fields.get("content-type", ""):
                self.http_fields = {}
            else:
                self.http += part
                end = self.http.find(b"\r\n\r\n")
                if end < 0:
                    if len(self.http) > MAX_HEADER:
                        raise ValueError("HTTP header without an end")
                    return
                self.http_fields, part, self.http = self._fields(self.http[:end]), self.http[end + 4 :], b""
        self.payload.update(part)
        self.payload_bytes += len(part)
        if self.keep:
            self.kept.append(part)

    def result(self) -> dict:
        """The record, after its last byte; ``error`` says what doesn't hold."""
        error = None
        fields = self.fields or {}
        kind = fields.get("warc-type")
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            error = "cut short"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = self.payload_bytes
        if error is None:
            said = fields.get("warc-block-digest", "").removeprefix("sha1:")
            if said and said != base32(self.block.digest()):
                error = "block digest differs"
            elif kind == "revisit":
                length = int(n) if (n := (self.http_fields or {}).get("content-length", "")).isdigit() else None
            elif digest and digest != base32(self.payload.digest()):
                error = "payload digest differs"
        return {
            "record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": kind, "uri": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": digest or (base32(self.payload.digest()) if self.fields and kind != "revisit" else None), "payload_bytes": length, "payload": b"".join(self.kept) if self.keep and kind != "revisit" else None, "error": error,
        }


def read_records(stream, keep_payload: bool = False, piece: int = PIECE) -> Iterator[dict]:
    """The records of an archive in order, each with the offset of its member.

    What can't be read ends the archive with a row that has only offset and error; a
    record that is whole but fails a check has its error and reading goes on.
    """
    offset, data, at_end = 0, b"", False
    while True:
        if not data and not at_end:
            data = stream.read(piece)
        if not data:
            return
        inflater, parser, used = zlib.decompressobj(31), RecordParser(keep_payload), 0
        try:
            while not inflater.eof:
                if not data:
                    data = stream.read(piece)
                    if not data:
                        at_end = True
                        raise ValueError("archive ends inside a record")
                size = len(data)
                parser.feed(inflater.decompress(data, piece))
                data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
                used += size - len(data)
            yield {"offset": offset, **parser.result()}
        except (ValueError, zlib.error) as e:
            yield {"offset": offset, "error": f"unreadable: {e}"}
            return
        offset += used


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` below ``folder`` and return (path, records, bytes), a written table.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the smallest
    id are responses and the others revisit them; a null id is never the smallest
    unless all are null, and then all are responses. Repeated rows of the smallest id
    are responses all. A null html is an empty payload, a null url leaves its field
    out. Each task writes one archive under a name of its own; the table lists those
    of the tasks that ended well, so a repeated task does no harm. No rows, no archive.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.where(F.length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    twins = settle(digests.groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "twins")
    keyed = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload"))
    marked = keyed.join(measured(twins), ["sha1", "size"], "left").drop("sha1", "size")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(source):
        path, out, records, size = None, None, 0, 0
        for batch in source:
            for page, url, body, first, again in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first_id", "again")), strict=True):
                if out is None:
                    place, root = fs.FileSystem.from_uri(folder)
                    place.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", place.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page.as_py(), url.as_py(), body.as_py(), first.as_py(), again.as_py())
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], schema=schema)

    written = marked.select("page_id", "url", "payload", "first_id", revisit.alias("again")).mapInArrow(run, "path string, records long, bytes long")
    return settle(written, "archives")


_ROWS = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to_id", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])
_ROWS_DDL = "path string, offset long, record_id string, record_type string, uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, error string"


def read_archives(paths: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives named in the column ``path``; an archive is read by one task, as a stream.

    payload_bytes of a revisit is the length that its HTTP header says, null if it says
    none; payload is null unless ``keep_payload``, and for revisits. error is null for a
    record whose framing and digests hold. If ``paths`` has a column ``records``, the
    task of an archive with fewer or more members fails.
    """

    def run(source):
        for batch in source:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                place, file = fs.FileSystem.from_uri(path)
                rows, size, members = [], 0, 0
                with place.open_input_stream(file, compression=None) as stream:
                    for row in read_records(stream, keep_payload):
                        rows.append({"path": path, **row})
                        members += 1
                        size += len(row.get("payload") or b"") + 500
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, _ROWS)
                            rows, size = [], 0
                if records is not None and members != records:
                    raise ValueError(f"{path} has {members} records and not {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)

    records = F.col("records").cast("long") if "records" in paths.columns else F.lit(None).cast("long")
    files = paths.select("path", records.alias("records")).where("path is not null")
    return files.repartition(max(1, files.count())).mapInArrow(run, _ROWS_DDL)


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back: page_id and refers_to as numbers, and what ``read_archives`` gives.

    Raises an error in the task that finds fewer or more records than were written or a record that fails a check.
    """
    written = write_archives(pages, new_folder(spark, "warc"), **columns)
    read = read_archives(written)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", F.col("offset").cast("string"), "error"))).otherwise(number("record_id"))
    return read.withColumn("page_id", sound.cast("long")).withColumn("refers_to", number("refers_to_id"))
