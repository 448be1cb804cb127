"""MP4 files by their headers: durations, sizes and rotation, and the sound track without decoding.

``probe`` and ``sound`` take a table of ``path`` and ``length`` (``tables.media_files`` without its content), so
Spark deals files to tasks by their bytes. A file is opened where it lies. Its boxes are walked from
header to header, so the pictures are never read: ``probe`` reads some hundred bytes a file,
``sound`` the track's tables and its samples, given in pieces.

A file that is broken, is no MP4 or is missing has ``broken`` and no more; an unknown duration (broken,
0, or all bits set) is 60 seconds. A file in fragments tells its duration in ``mehd`` or not at all.
Repeated paths give repeated rows, null paths are broken files. Spark's listing leaves out empty files
(``tables.media_files`` too); a path of one that is given otherwise is a broken file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed import _store

#: Seconds of a file that doesn't tell, bytes of sound in a row, rows that are given at once.
UNKNOWN, PIECE, ROWS = 60.0, 4 << 20, 1024
PROBED = "path string, duration double, width int, height int, rotation int, has_audio boolean, broken boolean, bytes_read long"
SOUND = "path string, codec string, piece int, content binary"


class Broken(ValueError):
    """What isn't as the format has it."""


class Reader:
    """A file that counts what is read of it."""

    def __init__(self, file: Any) -> None:
        self.file, self.size, self.told = file, file.size(), 0

    def at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        found = self.file.read(n)
        self.told += len(found)
        if len(found) < n:
            raise Broken("the file ends early")
        return found


Box = tuple[bytes, int, int]


def boxes(r: Reader, begin: int, end: int) -> Iterator[Box]:
    """Kind, begin and end of the bodies of the boxes in a range."""
    while begin + 8 <= end:
        head = r.at(begin, min(16, end - begin))
        size, skip = int.from_bytes(head[:4], "big"), 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - begin
        if size < skip or begin + size > end:
            raise Broken("a box goes beyond what holds it")
        yield head[4:8], begin + skip, begin + size
        begin += size


def _body(r: Reader, box: Box, most: int | None = None) -> bytes:
    return r.at(box[1], box[2] - box[1] if most is None else min(most, box[2] - box[1]))


def _whole(b: bytes, begin: int, n: int) -> int:
    if len(b) < begin + n:
        raise Broken("a box is too short")
    return int.from_bytes(b[begin : begin + n], "big")


def _seconds(b: bytes, scale: int | None = None) -> tuple[float | None, int]:
    """Duration and time scale of a movie's or track's header."""
    wide = _whole(b, 0, 1) == 1
    scale = _whole(b, 20 if wide else 12, 4)
    n = 8 if wide else 4
    units = _whole(b, 24 if wide else 16, n)
    return (units / scale if scale and units and units != (1 << 8 * n) - 1 else None), scale


@dataclass
class Track:
    kind: bytes = b""
    width: int = 0
    height: int = 0
    rotation: int = 0
    table: Box | None = None


def _track(r: Reader, trak: Box) -> Track:
    out = Track()
    for box in boxes(r, *trak[1:]):
        if box[0] == b"tkhd":
            b = _body(r, box, 96)
            at = 52 if _whole(b, 0, 1) == 1 else 40
            turn = [int.from_bytes(b[at + 4 * k : at + 4 * k + 4], "big", signed=True) for k in (0, 1)]
            out.rotation = round(math.degrees(math.atan2(turn[1], turn[0]))) % 360
            out.width, out.height = _whole(b, at + 36, 4) >> 16, _whole(b, at + 40, 4) >> 16
        elif box[0] == b"mdia":
            for inner in boxes(r, *box[1:]):
                if inner[0] == b"hdlr":
                    out.kind = _body(r, inner, 12)[8:12]
                elif inner[0] == b"minf":
                    out.table = next((x for x in boxes(r, *inner[1:]) if x[0] == b"stbl"), None)
    return out


def _movie(r: Reader) -> tuple[float | None, list[Track]]:
    moov = next((b for b in boxes(r, 0, r.size) if b[0] == b"moov"), None)
    if moov is None:
        raise Broken("there is no movie")
    seconds, scale, tracks, pieces = None, 0, [], None
    for box in boxes(r, *moov[1:]):
        if box[0] == b"mvhd":
            seconds, scale = _seconds(_body(r, box, 32))
        elif box[0] == b"trak":
            tracks.append(_track(r, box))
        elif box[0] == b"mvex":
            pieces = next((_body(r, x, 12) for x in boxes(r, *box[1:]) if x[0] == b"mehd"), None)
    if seconds is None and pieces and scale:
        seconds = (_whole(pieces, 4, 8 if pieces[0] == 1 else 4) / scale) or None
    return seconds, tracks


def _opened(path: str | None) -> Any:
    if path is None:
        raise Broken("no path")
    path = f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
    store, at = _store(path)
    return store.open_input_file(at)


def told(path: str | None) -> dict[str, Any]:
    """What a file's headers say."""
    out = {"path": path, "duration": UNKNOWN, "width": None, "height": None, "rotation": None, "has_audio": None, "broken": True, "bytes_read": 0}
    r = None
    try:
        with _opened(path) as file:
            r = Reader(file)
            seconds, tracks = _movie(r)
        out |= {"duration": seconds or UNKNOWN, "has_audio": any(t.kind == b"soun" for t in tracks), "broken": False}
        if seen := next((t for t in tracks if t.kind == b"vide"), None):
            out |= {"width": seen.width, "height": seen.height, "rotation": seen.rotation}
    except (Broken, FileNotFoundError):
        pass
    return out | {"bytes_read": r.told if r else 0}


def probe(files: DataFrame) -> DataFrame:
    """``PROBED`` columns of files by ``path``. Sizes are as stored; a rotation of 90 or 270 degrees exchanges them when shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("duration", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("rotation", pa.int32()), ("has_audio", pa.bool_()), ("broken", pa.bool_()), ("bytes_read", pa.int64())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([told(p) for p in batch.column(0).to_pylist()], schema=kind)

    return files.select("path").mapInArrow(run, PROBED)


def shown(width: str = "width", height: str = "height", rotation: str = "rotation") -> tuple[Any, Any]:
    """Width and height as shown."""
    turned = F.col(rotation).isin(90, 270)
    return F.when(turned, F.col(height)).otherwise(F.col(width)), F.when(turned, F.col(width)).otherwise(F.col(height))


def _described(b: bytes) -> tuple[int, bytes]:
    """Object type and decoder settings of an elementary stream."""

    def tag(at: int, want: int) -> tuple[int, int]:
        if _whole(b, at, 1) != want:
            raise Broken("a descriptor is missing")
        n, at = 0, at + 1
        while True:
            byte = _whole(b, at, 1)
            n, at = n << 7 | byte & 127, at + 1
            if byte < 128:
                return at, n

    at, _ = tag(4, 3)
    flags = _whole(b, at + 2, 1)
    at += 3 + 2 * (flags >> 7) + (1 + _whole(b, at + 3 + 2 * (flags >> 7), 1) if flags & 64 else 0) + 2 * (flags >> 5 & 1)
    at, n = tag(at, 4)
    kind = _whole(b, at, 1)
    if n <= 13:
        return kind, b""
    at, n = tag(at + 13, 5)
    return kind, b[at : at + n]


def _framing(stsd: bytes) -> tuple[str, tuple[int, int, int] | None]:
    """The codec's name and, for AAC, profile, index of the rate and channels for frame headers."""
    name = stsd[12:16].decode("latin-1")
    if name != "mp4a":
        return name, None
    begin = 8 + 36 + {0: 0, 1: 16, 2: 36}.get(_whole(stsd, 24, 2), 0)
    end = 8 + _whole(stsd, 8, 4)
    while begin + 8 <= min(end, len(stsd)):
        size = _whole(stsd, begin, 4)
        if size < 8:
            raise Broken("a box is too short")
        if stsd[begin + 4 : begin + 8] == b"esds":
            kind, settings = _described(stsd[begin + 8 : begin + size])
            if kind in (0x69, 0x6B):
                return "mp3", None
            if kind in (0x40, 0x66, 0x67, 0x68) and len(settings) >= 2:
                bits = int.from_bytes(settings[:2], "big")
                profile, rate, channels = bits >> 11, bits >> 7 & 15, bits >> 3 & 15
                if rate < 13 and channels < 8 and (profile in (1, 2, 3, 4, 5, 29)):
                    return "aac", (1 if profile > 4 else profile - 1, rate, channels)
            return name, None
        begin += size
    return name, None


def _adts(frame: tuple[int, int, int], n: int) -> bytes:
    """The header that makes a frame of ``n`` bytes playable by itself."""
    profile, rate, channels = frame
    if n + 7 >= 1 << 13:
        raise Broken("a frame is too long")
    bits = 0xFFF1 << 40 | profile << 38 | rate << 34 | channels << 30 | (n + 7) << 13 | 0x7FF << 2
    return bits.to_bytes(7, "big")


def _layout(r: Reader, table: Box) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Description, offsets of chunks, samples a chunk and bytes a sample, all within the file."""
    parts = {b[0]: b for b in boxes(r, *table[1:]) if b[0] in (b"stsd", b"stsz", b"stco", b"co64", b"stsc")}
    places = parts.get(b"co64") or parts.get(b"stco")
    if places is None or not {b"stsd", b"stsz", b"stsc"} <= parts.keys():
        raise Broken("a table is missing")
    raw = {k: _body(r, b) for k, b in (("stsd", parts[b"stsd"]), ("stsz", parts[b"stsz"]), ("places", places), ("stsc", parts[b"stsc"]))}
    each, n = _whole(raw["stsz"], 4, 4), _whole(raw["stsz"], 8, 4)
    chunks, runs = _whole(raw["places"], 4, 4), _whole(raw["stsc"], 4, 4)
    wide = 8 if places[0] == b"co64" else 4
    if len(raw["places"]) < 8 + wide * chunks or len(raw["stsc"]) < 8 + 12 * runs or (not each and len(raw["stsz"]) < 12 + 4 * n) or (each and n * each > r.size):
        raise Broken("a table is too short")
    sizes = np.full(n, each, np.int64) if each else np.frombuffer(raw["stsz"], ">u4", n, 12).astype(np.int64)
    offsets = np.frombuffer(raw["places"], f">u{wide}", chunks, 8).astype(np.int64)
    steps = np.frombuffer(raw["stsc"], ">u4", 3 * runs, 8).reshape(runs, 3).astype(np.int64)
    firsts = np.append(steps[:, 0], chunks + 1)
    if chunks and (not runs or firsts[0] != 1 or (np.diff(firsts) < 0).any()):
        raise Broken("chunks aren't in order")
    per = np.repeat(steps[:, 1], np.diff(firsts))
    ends = np.append(0, np.cumsum(sizes))
    if per.sum() != n or (chunks and (offsets + np.diff(ends[np.append(0, np.cumsum(per))])).max() > r.size) or (offsets < 0).any():
        raise Broken("samples aren't in the file")
    return raw["stsd"], offsets, per, sizes


def _heard(r: Reader) -> Iterator[tuple[str, bytes]]:
    """Codec and bytes of the first sound track in pieces; '' and no bytes if there is none."""
    track = next((t for t in _movie(r)[1] if t.kind == b"soun"), None)
    if track is None:
        yield "", b""
        return
    if track.table is None:
        raise Broken("a table is missing")
    stsd, offsets, per, sizes = _layout(r, track.table)
    codec, frame = _framing(stsd)
    if frame and len(sizes) and sizes.max() + 7 >= 1 << 13:
        raise Broken("a frame is too long")
    out, at = bytearray(), 0
    for offset, n in zip(offsets.tolist(), per.tolist()):
        for begin in range(at, at + n, 4096):  # a chunk of a thousand samples and more is read in parts
            some = sizes[begin : min(begin + 4096, at + n)].tolist()
            data, cut = r.at(offset, sum(some)), 0
            offset += len(data)
            if frame is None:
                out += data
            else:
                for size in some:
                    out += _adts(frame, size) + data[cut : cut + size]
                    cut += size
            while len(out) >= PIECE:
                yield codec, bytes(out[:PIECE])
                del out[:PIECE]
        at += n
    yield codec, bytes(out)


def sound(files: DataFrame) -> DataFrame:
    """The first sound track of files by ``path`` as a stream that plays by itself: ``path, codec, piece, content``.

    ``aac`` frames get ADTS headers, ``mp3`` frames are as they are, other codecs are samples one after the
    other under their own name. A file without sound has codec '' and one empty piece, a broken one codec
    null and content null. Pieces are numbered from 0 and have 4 MB (``PIECE``), the last one less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("codec", pa.string()), ("piece", pa.int32()), ("content", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with _opened(path) as file:
                        for k, (codec, content) in enumerate(_heard(Reader(file))):
                            rows.append({"path": path, "codec": codec, "piece": k, "content": content})
                            size += len(content)
                            if size >= PIECE:
                                yield pa.RecordBatch.from_pylist(rows, schema=kind)
                                rows, size = [], 0
                except (Broken, FileNotFoundError):
                    rows.append({"path": path, "codec": None, "piece": 0, "content": None})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("path").mapInArrow(run, SOUND)
