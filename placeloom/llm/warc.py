"""WARC archives as a PySpark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes one file, a gzip member per record, under a temporary name; the commit
renames the files of successful tasks, so a lost task's file is never read. A member's header holds
the member's compressed length (the ``sl`` extra field), so a reader can step over it.

Reading: files are planned as partitions of about ``split`` bytes by their sizes alone, no file is
opened for it; a task begins where the first member in its range begins. Filters on the record type and other header columns are pushed down: only the head
of a member is inflated for its headers, and an unwanted record's payload is stepped over, neither
inflated nor decoded. Archives of other writers are read too: where members lack the field or aren't
compressed, the task of a file's first range reads all of it.

Option ``payload`` (true): with false no payload is decoded and ``payload`` is null. Option
``verify`` (false): with true each decoded payload of a response must have the digest in its header.
Option ``slices`` (0): the number of partitions to aim at, where ``split`` would give fewer.

Files are opened with pyarrow's file systems, so the folder may be in any store that pyarrow reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import scratch_path, small, stored

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Header columns by the WARC header that holds them.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08\x04"
_HEAD = struct.Struct("<4sIBBH2sHII")  # magic and flags, time, extra flags, system, extra length, "sl", 8, compressed, plain
_SPLIT, _LEAST_SPLIT = 64 << 20, 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(plain: bytes) -> bytes:
    """A gzip member whose header tells its own compressed length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = _HEAD.size + len(body) + 8
    head = _HEAD.pack(_MEMBER, 0, 0, 255, 12, b"sl", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, date: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record in plain bytes. A revisit keeps the payload's length and digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date or '1970-01-01T00:00:00Z'}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _pending(self, base: str) -> str:
        return f"{base}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                at = {c: k for k, c in enumerate(batch.schema.names)}
                cols = [batch.column(at[c]) for c in ("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload")]
                for k in range(batch.num_rows):
                    kind, rid, uri, date, refers, payload = (c[k].as_py() for c in cols)
                    if out is None:
                        store.create_dir(self._pending(base), recursive=True)
                        out = store.open_output_stream(f"{self._pending(base)}/{name}", compression=None)
                    out.write(member(record(kind, rid, uri, date, refers, payload or b"")))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _opened(self.path)
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(pafs.FileSelector(base)):
                if old.type == pafs.FileType.File:
                    store.delete_file(old.path)
        for m in messages:
            if isinstance(m, Written) and m.name:
                store.move(f"{self._pending(base)}/{m.name}", f"{base}/{m.name}")
        self._clear(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: pafs.FileSystem, base: str) -> None:
        if store.get_file_info(self._pending(base)).type == pafs.FileType.Directory:
            store.delete_dir(self._pending(base))


@dataclass
class Piece(InputPartition):
    """Byte ranges ``(file, start, end)``; a record belongs to the range where its member begins."""

    ranges: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.names = options["path"], schema.names
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split, self.slices = int(options.get("split", _SPLIT)), int(options.get("slices", 0))
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and prefix on header columns; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.equal.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.equal.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.prefix.append((column, f.value))
            elif not (column in HEADERS and isinstance(f, IsNotNull) and column == "record_type"):
                yield f

    def wanted(self, head: dict[str, str | None]) -> bool:
        return all(head[c] in values for c, values in self.equal) and all((head[c] or "").startswith(p) for c, p in self.prefix)

    def partitions(self) -> list[InputPartition]:
        store, base = _opened(self.path)
        info = store.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base))
        files = sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        split = min(self.split, max(_LEAST_SPLIT, sum(f.size for f in files) // self.slices)) if self.slices else self.split
        pieces: list[InputPartition] = []
        room, held = 0, []
        for f in files:
            for start in range(0, f.size, split):
                end = min(f.size, start + split)
                if held and room + end - start > split:
                    pieces.append(Piece(held))
                    room, held = 0, []
                held.append((f.path, start, end))
                room += end - start
        return [*pieces, Piece(held)] if held else pieces

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, _ = _opened(self.path)
        rows: list[dict] = []
        size = 0
        for path, start, end in partition.ranges:
            with store.open_input_file(path) as src:
                for row in self._records(src, start, end):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], self.names)

    def _records(self, src: pa.NativeFile, start: int, end: int) -> Iterator[dict]:
        first = src.read(16)
        if first.startswith(_MEMBER) and first[12:14] == b"sl":
            yield from self._members(src, start, end)
        elif start == 0:
            src.seek(0)
            yield from self._stream(src, first.startswith(b"\x1f\x8b"))

    def _members(self, src: pa.NativeFile, start: int, end: int) -> Iterator[dict]:
        total = src.size()
        at = start if start == 0 or self._valid(src, start, total) else self._next(src, start, end, total)
        while at is not None and at < end:
            src.seek(at)
            head = _HEAD.unpack(src.read(_HEAD.size))
            length = head[7]
            inflate = zlib.decompressobj(-15)
            room = length - _HEAD.size - 8
            plain, rest = b"", b""
            while b"\r\n\r\n" not in plain and not inflate.eof and room + len(rest):
                if not rest:
                    rest = src.read(min(2048, room))
                    room -= len(rest)
                plain += inflate.decompress(rest, 4096)
                rest = inflate.unconsumed_tail
            row, block = self._parsed(plain)
            if row is not None:
                if self.payload and row["record_type"] != "revisit":
                    block += inflate.decompress(rest + src.read(room)) + inflate.flush()
                elif b"\r\n\r\n" not in block:
                    block += inflate.decompress(rest, 4096)
                yield self._finished(row, block)
            at += length

    def _valid(self, src: pa.NativeFile, at: int, total: int) -> bool:
        """Whether a member begins here: the member that its length leads to begins like one too, or the file ends."""
        src.seek(at)
        raw = src.read(_HEAD.size)
        if len(raw) < _HEAD.size or not raw.startswith(_MEMBER) or raw[12:14] != b"sl":
            return False
        follows = at + _HEAD.unpack(raw)[7]
        if follows >= total:
            return follows == total
        src.seek(follows)
        return src.read(4) == _MEMBER

    def _next(self, src: pa.NativeFile, start: int, end: int, total: int) -> int | None:
        at, kept = start, b""
        src.seek(start)
        while at < end:
            chunk = kept + src.read(min(1 << 20, total - at))
            base = at - len(kept)
            for m in re.finditer(re.escape(_MEMBER), chunk):
                if base + m.start() < end and self._valid(src, base + m.start(), total):
                    return base + m.start()
            at = base + len(chunk)
            kept = chunk[-3:]
            src.seek(at)
            if at >= total:
                return None
        return None

    def _stream(self, src: pa.NativeFile, packed: bool) -> Iterator[dict]:
        """Archives without member lengths, from the start; bodies of unwanted records are dropped as they pass."""
        inflate = zlib.decompressobj(31) if packed else None
        plain, raw, over = b"", b"", False

        def more() -> bool:
            nonlocal plain, raw, inflate, over
            if not raw:
                raw = src.read(1 << 16)
                over = not raw
            if inflate is None:
                plain, raw = plain + raw, b""
            elif raw:
                plain += inflate.decompress(raw)
                raw = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            return not over

        while True:
            plain = plain.lstrip(b"\r\n")
            while b"\r\n\r\n" not in plain and more():
                plain = plain.lstrip(b"\r\n")
            cut = plain.find(b"\r\n\r\n")
            if cut < 0:
                return
            row, _ = self._parsed(plain[: cut + 4])
            length = int(self._fields(plain[:cut]).get("content-length", "0"))
            plain = plain[cut + 4 :]
            keep, block = row is not None, []
            while length:
                if not plain and not more():
                    break
                taken, plain = plain[:length], plain[length:]
                length -= len(taken)
                if keep:
                    block.append(taken)
            if keep:
                yield self._finished(row, b"".join(block) + b"\r\n\r\n")

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def _parsed(self, plain: bytes) -> tuple[dict | None, bytes]:
        """The header columns, or None if the record is unwanted, and what follows the headers."""
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = self._fields(head)
        row: dict = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c][1:-1] if row[c] and row[c].startswith("<") else row[c]
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not self.wanted(row):
            return None, b""
        row["_content"] = int(fields.get("content-length", "0"))
        row["_http"] = fields.get("content-type", "").startswith("application/http")
        return row, rest

    def _finished(self, row: dict, block: bytes) -> dict:
        block = block[: row["_content"]]
        row["payload"], row["payload_length"] = None, None
        if row["_http"]:
            head, _, body = block.partition(b"\r\n\r\n")
            length = self._fields(head).get("content-length")
            row["payload_length"] = int(length) if length and length.isdigit() else None
            if self.payload and row["record_type"] != "revisit":
                row["payload"], row["payload_length"] = body, len(body)
        elif self.payload:
            row["payload"], row["payload_length"] = block, len(block)
        if self.verify and row["payload"] is not None and row["payload_digest"] and digest(row["payload"]) != row["payload_digest"]:
            raise ValueError(f"payload of {row['record_id']} does not have the digest in its header")
        return row


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, prefix: str, least_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page for the writer: of pages with equal payloads of ``least_bytes`` or more, that of the largest id is the response and the others revisit it.

    Null html is an empty payload; a null id never is the response unless all are null; rows repeated with
    their id are all responses; a null url writes no target. Extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n"), F.col(url).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    sums = rows.where(F.length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("sum")).agg(F.max("n").alias("last"), F.count("*").alias("rows"))
    # only payloads that occur twice or more are joined, so that the pages needn't be shuffled where these are few
    shared = small(stored(sums.where("rows > 1 and last is not null").select("sum", F.col("last").alias("last")), "payloads"))
    joined = rows.join(shared, (F.sha1("payload") == F.col("sum")) & (F.length("payload") >= least_bytes), "left")
    revisit = F.col("last").isNotNull() & ~F.col("n").eqNullSafe(F.col("last"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit(prefix), F.coalesce("id", F.lit(""))).alias("record_id"), "target_uri",
        F.lit("2025-01-01T00:00:00Z").alias("warc_date"), F.lit(None).cast("string").alias("payload_digest"), F.when(revisit, F.concat(F.lit(prefix), F.col("last").cast("string"))).alias("refers_to"),
        F.length("payload").cast("long").alias("payload_length"), "payload",
    )


def archive(pages: DataFrame, prefix: str, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: responses with checked digests, revisits by their headers alone."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    records(pages, prefix, least_bytes).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("slices", spark.sparkContext.defaultParallelism)
    whole = read.option("verify", "true").load(path).where("record_type = 'response'")
    headers = read.option("payload", "false").load(path).where("record_type = 'revisit'")
    return whole.unionByName(headers)
