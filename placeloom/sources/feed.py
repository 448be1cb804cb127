"""Webhook logs as a streaming source, and event streams as a sink, both exact over failures.

``webhook_log`` reads the lines of append-only logs in a folder. Logs are ordered by name and only the
last one grows, so an offset is a name and a number of bytes; a micro-batch is planned as ranges of
bytes, and the same offsets always give the same lines. ``event_log`` writes messages. Each task
writes a file; the commit of a micro-batch lists its files under the batch's number in one step, and a
repeated batch finds its number taken. Only listed files are read.

Both go through the store's own file system and work on executors. A line without its end is not
read yet; empty lines are no rows. A folder that is missing or empty has no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that a task reads, about, and that are read at once to find the last whole line.
RANGE, TAIL = 32 << 20, 1 << 16


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _files(path: str) -> list[pafs.FileInfo]:
    store, base = _store(path)
    found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


@dataclass
class Lines(InputPartition):
    """The lines that begin within a range of a log."""

    name: str
    begin: int
    end: int

    def __init__(self, name: str, begin: int, end: int) -> None:
        self.name, self.begin, self.end = name, begin, end


class LogStream(DataSourceStreamReader):
    """Offsets are ``{"name", "bytes"}``: all logs before that one, and so many bytes of it."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"name": "", "bytes": 0}

    def latestOffset(self) -> dict:
        found = _files(self.path)
        return {"name": found[-1].base_name, "bytes": self._whole(found[-1])} if found else self.initialOffset()

    def _whole(self, log: pafs.FileInfo) -> int:
        """Bytes up to the end of the last whole line."""
        store, _ = _store(self.path)
        with store.open_input_file(log.path) as f:
            end = log.size
            while end:
                begin = max(0, end - TAIL)
                f.seek(begin)
                if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for log in _files(self.path):
            if start["name"] <= log.base_name <= end["name"]:
                begin = start["bytes"] if log.base_name == start["name"] else 0
                upto = end["bytes"] if log.base_name == end["name"] else log.size
                out += [Lines(log.base_name, a, min(upto, a + self.size)) for a in range(begin, upto, self.size)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        store, base = _store(self.path)
        with store.open_input_file(f"{base}/{partition.name}") as f:
            at, rest = partition.begin, b""
            if at:  # the line that began before belongs to the range before
                f.seek(at - 1)
                rest, at = f.read(1), at - 1
            else:
                f.seek(0)
            skip = bool(rest)
            while at < partition.end:
                while (cut := rest.find(b"\n")) < 0 and (more := f.read(TAIL)):
                    rest += more
                line, rest = (rest[:cut], rest[cut + 1 :]) if cut >= 0 else (rest, b"")
                if not skip and line.strip():
                    yield partition.name, at, line.decode("utf-8", "replace")
                at, skip = at + len(line) + 1, False
                if cut < 0:
                    break

    def commit(self, end: dict) -> None:
        """Logs stay; who writes them may remove those before a committed offset."""


class WebhookLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webhook_log"

    def schema(self) -> str:
        return "log string, position long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


@dataclass
class Staged(WriterCommitMessage):
    name: str
    messages: int


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, base = _store(self.path)
        name, n = f"{uuid.uuid4().hex}.events", 0
        store.create_dir(f"{base}/files", recursive=True)
        with store.open_output_stream(f"{base}/files/{name}") as f:
            for row in iterator:
                f.write(row[0].encode() if row[0] else b"")
                n += 1
        return Staged(name, n)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, base = _store(self.path)
        listed = f"{base}/batches/{batchId:012d}.json"
        if store.get_file_info(listed).type == pafs.FileType.File:  # the batch was written before it was repeated
            self.abort(messages, batchId)
            return
        store.create_dir(f"{base}/batches", recursive=True)
        hidden = f"{base}/batches/_{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps([m.name for m in messages if m is not None and m.messages]).encode())
        store.move(hidden, listed)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, base = _store(self.path)
        for m in messages:
            if m is not None and store.get_file_info(f"{base}/files/{m.name}").type == pafs.FileType.File:
                store.delete_file(f"{base}/files/{m.name}")


@dataclass
class Batch(InputPartition):
    number: int
    name: str

    def __init__(self, number: int, name: str) -> None:
        self.number, self.name = number, name


class EventReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for listed in _files(f"{self.path}/batches"):
            with _store(self.path)[0].open_input_file(listed.path) as f:
                out += [Batch(int(listed.base_name.split(".")[0]), name) for name in json.loads(f.read())]
        return out or [Batch(-1, "")]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if partition.number < 0:
            return
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/files/{partition.name}") as f:
            rest = b""
            while more := f.read(TAIL):
                *whole, rest = (rest + more).split(b"\n\n")
                yield from ((partition.number, m.decode() + "\n\n") for m in whole)


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "batch long, message string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EventWriter(self.options["path"])


def webhook_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream ``log, position, line`` of the lines of a folder's logs; log and position are a line's identity."""
    spark.dataSource.register(WebhookLog)
    return spark.readStream.format("webhook_log").option("path", path).option("rangeBytes", str(range_bytes)).load()


def write_events(messages: DataFrame, path: str, checkpoint: str):
    """A writer of a stream of messages (the first column, each closed by an empty line) to an event log."""
    messages.sparkSession.dataSource.register(EventLog)
    return messages.writeStream.format("event_log").option("path", path).option("checkpointLocation", checkpoint)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``batch, message`` of an event log; what no commit listed isn't there."""
    spark.dataSource.register(EventLog)
    return spark.read.format("event_log").option("path", path).load()
