"""WARC archives as a Spark data source, for reading and writing.

``spark.read.format("warc").load(folder)`` plans a partition per archive, or per
bundle of small ones. Filters on header columns are pushed into the reader: it
parses the header of a record first, and only records that pass have their payload
inflated. With ``option("payload", "false")`` none has. Records are gzip members of
their own; archives written here note each member's length in its header, so that
the rest of an unwanted record is skipped without being inflated. Plain ``.warc``
files are read too.

Writing is safe against lost executors: a task writes files of its own, which get
their place only when the job is committed; those of other attempts are removed.

* A null payload is empty; null header values leave out the header, and a record
  without a type is ``response``, without an id gets one of its own.
* Line breaks and spaces in addresses are percent-encoded, so no value can end a header.
* Extra columns are not written. An empty folder or table reads as no records.
* A long payload is one record, whatever its size; only its own batch holds it.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from citewright.session import scratch_dir

SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
HEADERS = {
    "warc-record-id": "record_id",
    "warc-type": "warc_type",
    "warc-target-uri": "target_uri",
    "warc-date": "warc_date",
    "warc-refers-to": "refers_to",
    "warc-payload-digest": "payload_digest",
}
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# An archive is closed at this size; a partition reads about this much.
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
# Inflated at first, to see the headers.
HEAD_BYTES = 4096

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _escaped(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# --- writing


def record(row: dict) -> bytes:
    """One record: its headers, the headers of the page, and the payload unless it is a revisit."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    size = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    values = {
        "WARC-Type": row["warc_type"] or "response",
        "WARC-Record-ID": f"<{_escaped(row['record_id'] or uuid.uuid4().urn)}>",
        "WARC-Date": _escaped(row["warc_date"] or NO_DATE),
        "WARC-Target-URI": row["target_uri"] and _escaped(row["target_uri"]),
        "WARC-Refers-To": row["refers_to"] and f"<{_escaped(row['refers_to'])}>",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Payload-Digest": row["payload_digest"] and _escaped(row["payload_digest"]),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{name}: {value}\r\n" for name, value in values.items() if value)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member whose extra field ``sl`` holds the member's and the data's length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.path)
        waiting = f"{folder}/_waiting-{self.job}"
        system.create_dir(waiting, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{waiting}/{files[-1]}", compression=None), 0
                data = member(record({name: row.get(name) for name in COLUMNS}))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for entry in system.get_file_info(pafs.FileSelector(folder)):
                if ".warc" in entry.base_name:
                    system.delete_file(entry.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{folder}/_waiting-{self.job}/{name}", f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, system: pafs.FileSystem, folder: str) -> None:
        waiting = f"{folder}/_waiting-{self.job}"
        if system.get_file_info(waiting).type == pafs.FileType.Directory:
            system.delete_dir(waiting)


# --- reading


class Bounds(InputPartition):
    """The archives that one task reads."""


def _test(filter_: Filter) -> Callable[[dict], bool] | None:
    """``filter_`` as a test of header values; nothing, if it needs more than those."""
    if isinstance(filter_, Not):
        inner = _test(filter_.child)
        if inner is None or isinstance(filter_.child, (IsNull, IsNotNull, EqualNullSafe, Not)):
            return None
        name = filter_.child.attribute[0]
        return lambda row: row[name] is not None and not inner(row)
    name = filter_.attribute[0] if len(getattr(filter_, "attribute", ())) == 1 else None
    if name not in COLUMNS or name == "payload":
        return None
    if isinstance(filter_, IsNull):
        return lambda row: row[name] is None
    if isinstance(filter_, IsNotNull):
        return lambda row: row[name] is not None
    value = filter_.value
    if isinstance(filter_, EqualNullSafe):
        return lambda row: row[name] == value
    compare = {
        EqualTo: lambda x: x == value,
        In: lambda x: x in value,
        GreaterThan: lambda x: x > value,
        GreaterThanOrEqual: lambda x: x >= value,
        LessThan: lambda x: x < value,
        LessThanOrEqual: lambda x: x <= value,
        StringStartsWith: lambda x: x.startswith(value),
        StringEndsWith: lambda x: x.endswith(value),
        StringContains: lambda x: value in x,
    }.get(type(filter_))
    if compare is None or value is None:
        return None
    return lambda row: row[name] is not None and compare(row[name])


def header_values(head: bytes) -> tuple[dict, int, int]:
    """Column values, the offset of the block and its length, from the start of a record.

    The offset is negative if ``head`` ends before the headers do.
    """
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        return {}, -1, 0
    row: dict = dict.fromkeys(COLUMNS)
    length = 0
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name in HEADERS:
            row[HEADERS[name]] = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
        elif name == "content-length":
            length = int(value)
    return row, stop + 4, length


def _page(block: bytes) -> tuple[int, int | None]:
    """Where the payload begins behind the page's own headers, and the length those state."""
    stop = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or stop < 0:
        return 0, None
    stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[: stop + 2])
    return stop + 4, int(stated[1]) if stated else None


class _Input:
    """A file read forward, with some of what lies ahead in view."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.held = stream, b""

    def ahead(self, size: int) -> bytes:
        if len(self.held) < size:
            self.held += self.stream.read(max(size, 1 << 18) - len(self.held)) or b""
        return self.held[:size]

    def skip(self, size: int) -> None:
        beyond = size - len(self.held)
        self.held = self.held[size:]
        if beyond > 0:
            self.stream.seek(beyond, 1)


def _member_length(head: bytes) -> int | None:
    """The length of a gzip member, if its header notes it."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, stop = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(stop, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + size
    return None


def _inflated(data: _Input, wanted: Callable[[dict], bool]) -> bytes:
    """The member that begins here; empty, once its headers turn out unwanted. Reads to its end."""
    inflate, text, judged, keep = zlib.decompressobj(31), b"", False, True
    parts: list[bytes] = []
    while not inflate.eof:
        chunk = data.ahead(1 << 16)
        if not chunk:
            raise ValueError("an archive ends within a record")
        part = inflate.decompress(chunk)
        data.skip(len(chunk) - len(inflate.unused_data))
        if keep:
            parts.append(part)
        if not judged:
            text += part
            row, offset, _ = header_values(text)
            judged = offset >= 0
            if judged and not wanted(row):
                keep, parts = False, []
    return b"".join(parts)


def _zipped(data: _Input, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    while start := data.ahead(HEAD_BYTES):
        length = _member_length(start)
        if length is None:
            text = _inflated(data, wanted)
            row, offset, size = header_values(text)
            if offset >= 0:
                yield _finished(row, text[offset : offset + size], size, payload)
            continue
        text = zlib.decompressobj(31).decompress(start[:length], HEAD_BYTES)
        row, offset, size = header_values(text)
        if offset < 0 or (wanted(row) and (payload or text.find(b"\r\n\r\n", offset) < 0)):
            text = zlib.decompress(data.ahead(length), 31)
            row, offset, size = header_values(text)
        if offset >= 0 and wanted(row):
            yield _finished(row, text[offset : offset + size], size, payload)
        data.skip(length)


def _plain(data: _Input, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    size = HEAD_BYTES
    while head := data.ahead(size):
        blank = len(head) - len(head.lstrip(b"\r\n"))
        if blank:
            data.skip(blank)
            continue
        row, offset, length = header_values(head)
        if offset < 0:
            if len(head) < size:
                raise ValueError("an archive ends within a header")
            size *= 2
            continue
        size = HEAD_BYTES
        data.skip(offset)
        if wanted(row):
            shown = length if payload else min(length, HEAD_BYTES)
            yield _finished(row, data.ahead(shown), length, payload)
        data.skip(length)


def _finished(row: dict, block: bytes, size: int, payload: bool) -> dict:
    begin, stated = _page(block)
    row["payload_length"] = size - begin if stated is None else stated
    if payload and row["warc_type"] != "revisit":
        row["payload"] = block[begin:]
    return row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for filter_ in filters:
            # The length is known only once a record was chosen.
            names = {name[0] for name in (getattr(f, "attribute", ("",)) for f in (filter_, getattr(filter_, "child", filter_)))}
            if "payload_length" in names or _test(filter_) is None:
                yield filter_
            else:
                self.filters.append(filter_)

    def partitions(self) -> list[Bounds]:
        system, folder = _filesystem(self.path)
        found = system.get_file_info(folder)
        if found.type == pafs.FileType.Directory:
            entries = system.get_file_info(pafs.FileSelector(folder))
            entries = [e for e in entries if e.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", e.base_name)]
        else:
            entries = [found] if found.type == pafs.FileType.File else []
        parts: list[list[str]] = []
        room = 0
        for entry in sorted(entries, key=lambda e: e.path):
            if not parts or entry.size > room:
                parts.append([])
                room = ARCHIVE_BYTES
            parts[-1].append(entry.path)
            room -= entry.size
        return [Bounds(files) for files in parts] or [Bounds([])]

    def read(self, partition: Bounds) -> Iterator[pa.RecordBatch]:
        tests = [_test(filter_) for filter_ in self.filters]
        wanted = lambda row: all(test(row) for test in tests)
        schema = pa.schema([(n, {"payload": pa.binary(), "payload_length": pa.int64()}.get(n, pa.string())) for n in COLUMNS])
        system, _ = _filesystem(self.path)
        held: list[dict] = []
        size = 0
        for path in partition.value:
            with system.open_input_file(path) as stream:
                records = (_zipped if path.endswith(".gz") else _plain)(_Input(stream), wanted, self.payload)
                for row in records:
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages


def page_records(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record for each page. Of equal payloads of ``least`` bytes or more, those with the largest
    key are responses and the others revisit it; a null key counts as the least of all."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    large = rows.filter(F.col("size") >= least)
    again = large.groupBy("digest", "size").agg(F.count("*").alias("times"), F.max("page").alias("kept")).filter("times > 1")
    again = again.select("digest", F.col("size"), "kept")
    ident = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    revisit = F.col("kept").isNotNull() & ~F.col("page").eqNullSafe(F.col("kept"))
    return rows.join(again, ["digest", "size"], "left").select(
        ident("page").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("warc_date"),
        F.when(revisit, ident("kept")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, written as
    archives to ``folder`` and read back. What the archives hold is digested anew; of
    revisits only the headers are read."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    page_records(pages).write.format("warc").mode("append").save(folder)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    of = lambda digest, size: [
        number("record_id").alias("page_id"),
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    ]
    read = spark.read.format("warc")
    responses = read.load(folder).filter(F.col("warc_type") == "response")
    revisits = spark.read.format("warc").option("payload", "false").load(folder).filter(F.col("warc_type") == "revisit")
    return responses.select(*of(F.sha1("payload"), F.length("payload").cast("long"))).unionByName(
        revisits.select(*of(F.substring_index("payload_digest", ":", -1), F.col("payload_length")))
    )
