"""Helpers that several operators share: scratch tables, Arrow text buffers, checked broadcasts, what workers keep."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many (narrow) rows may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 50_000

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster there is nowhere to write.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="placeloom-")
        _OWN[context.applicationId] = path
    return path.rstrip("/")


def clear_scratch(spark: SparkSession, hours: float, folder: str | None = None) -> int:
    """Remove what operators left in the shared folder (or another) more than ``hours`` ago; the number of folders. Results that still read them are lost."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder or shared_dir(spark))
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - 3600 * hours) * 1000, 0
    for f in store.listStatus(top) if store.exists(top) else []:
        if f.getPath().getName().startswith("placeloom-") and f.getModificationTime() < before:
            gone += bool(store.delete(f.getPath(), True))
    return gone


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/placeloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    release()
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the side, counted, is within the limit. ``df`` should be stored already."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bitmap(keys: DataFrame, column: str, n: int, most: int) -> np.ndarray:
    """A bitmap (bytes, lowest bit first) of the low bits of ``n`` keys, of ``most`` bits at most; a broadcast of a bounded size."""
    bits = 1 << 15
    while bits < min(most, 32 * n):
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none of those taken (Spark compares them without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column, "") if column.null_count else column
    flat = flat.cast(pa.large_string())
    _, offsets, data = flat.buffers()
    off = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_KEPT: dict[object, Any] = {}


def keep(key: object, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing at most, so that the stages of a session don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what the worker keeps, for tasks that have no use for it."""
    if _KEPT:
        _KEPT.clear()
        release()


def release() -> None:
    """Give freed memory back to the system, where the C library can; in workers after a partition, in the driver after a table is stored."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18, keeps: object = None) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each (one row at least), so memory doesn't follow the batch size.

    What the worker keeps for anything but ``keeps`` is dropped; freed memory goes back at the end of the partition.
    """
    if keeps not in _KEPT:
        _KEPT.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        block = np.cumsum(sizes + 64) // most
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x.copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_ODD = 0x5851F42D4C957F2D
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse; those of a chunk are kept."""
    if n > _CHUNK or not _POWERS:
        up, down = np.full(max(n, _CHUNK), _ODD, np.uint64), np.full(max(n, _CHUNK), pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = [np.cumprod(up), np.cumprod(down)]
        if n > _CHUNK:
            return made
        _POWERS[:] = made
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial modulo 2^64; equal spans have equal hashes.

    Spans must be in order and not overlap: they are hashed by chunks of about ``_CHUNK`` bytes, so that memory doesn't
    follow the length of a text (but that of its longest span).
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, first + _CHUNK, "left")))
        part = data[first : int(ends[b - 1])]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mix64(out)
