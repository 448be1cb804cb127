"""Chroma audio fingerprints of a media column, and their alignment.

A recording (WAV bytes, 8 or 16-bit PCM, any rate and channels) becomes pitch-class frames; filters
over their integral image compare rectangles of time and pitch class, and each answer is quantised
to two bits of Gray code, so a position is one packed 32-bit integer. Recordings align where equal
integers agree on an offset: a quarter of the bits of four integers, which stand apart so that chance seldom
repeats them, are looked up; the histogram of offsets, in which neighbours share their votes, gives the best one;
and the share of wrong bits over the overlap, there and beside it, decides.

Recordings with the same integers are one class; classes are searched by their representative (least
id), so a hot group of copies is one row. Silence is not looked up: silent recordings only share a
class. Null, empty and unreadable media have no frames and match nothing. Repeated rows and null ids
count as members; extra columns are ignored; an empty table gives an empty result. A very long
recording is read where it lies and transformed some hundred frames at a time: beside its own bytes an
hour takes some 100 MB, most of them for its integral image.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored

FRAME_SECONDS = 0.256
HOPS = 4
FRAMES_AT_ONCE = 256
LOWEST, HIGHEST = 100.0, 1800.0
#: Sixteen filters: kind, first pitch class, pitch classes, frames; the pitch classes wrap around.
FILTERS = [(i % 4, (5 * i) % 12, (4, 6, 12, 8)[(i // 4 + i) % 4], (4, 8, 6, 12)[i % 4]) for i in range(16)]
WIDEST = max(f[3] for f in FILTERS)
#: Answers beyond these are the outer of four levels, by kind of filter.
OUTER = (0.45, 0.12, 0.35, 0.12)
#: Where the integers stand of which a byte each is looked up together.
STEPS = (0, 5, 10, 15)
_GRAY = np.array([0, 1, 3, 2], np.uint64)


def _open(media: bytes | pa.Buffer | None) -> wave.Wave_read | None:
    """The recording, read where it lies; None if it can't be read."""
    try:
        w = wave.open(pa.BufferReader(media if media is not None else b""))
    except (wave.Error, EOFError):
        return None
    return w if w.getsampwidth() in (1, 2) and w.getnchannels() and w.getframerate() else None


def _mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128 if width == 1 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)


def samples(media: bytes | pa.Buffer | None) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1, and the rate."""
    w = _open(media)
    return (_mono(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()) if w else (np.zeros(0), 0)


def frames(media: bytes | pa.Buffer | None, at_once: int = FRAMES_AT_ONCE) -> np.ndarray:
    """The frames of ``chroma`` of a whole recording, which is read and transformed ``at_once`` frames at a time."""
    w = _open(media)
    if not w:
        return np.zeros((0, 12))
    size = frame_size(w.getframerate())
    hop, left, out = size // HOPS, np.zeros(0, np.float32), [np.zeros((0, 12))]
    while raw := w.readframes(size + (at_once - 1) * hop - len(left)):
        x = np.concatenate([left, _mono(raw, w.getsampwidth(), w.getnchannels())])
        found = chroma(x, w.getframerate())
        out.append(found)
        left = x[len(found) * hop :]
    return np.concatenate(out)


def frame_size(rate: int) -> int:
    return 1 << max(4, round(np.log2(FRAME_SECONDS * rate)))


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch classes of unit length; silent frames are zero."""
    if not rate:
        return np.zeros((0, 12))
    size = frame_size(rate)
    hop = size // HOPS
    if len(x) < size:
        return np.zeros((0, 12))
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size).astype(np.float32)
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    freq = np.arange(power.shape[1]) * rate / size
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    pitch = np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12
    used = used[np.argsort(pitch, kind="stable")]
    there, at = np.unique(np.sort(pitch), return_index=True)
    out = np.zeros((len(power), 12))
    if len(there):  # sums by pitch class, without a matrix product and its threads
        out[:, there] = np.sqrt(np.add.reduceat(power[:, used], at, axis=1))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3 * size, out / np.maximum(norm, 1e-9), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer per position, as int32; 0 where all frames in reach are silent."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), axis=0), axis=1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint64)
    for k, (kind, y, height, width) in enumerate(FILTERS):
        t, h, third = width // 2, height // 2, max(1, width // 3)
        whole = area(0, width, y, y + height)
        if kind == 0:  # low against high pitch classes
            a = area(0, width, y, y + h)
        elif kind == 1:  # before against after
            a = area(0, t, y, y + height)
        elif kind == 2:  # two corners against the others
            a = area(0, t, y, y + h) + area(t, width, y + h, y + height)
        else:  # the middle against both ends
            a = area(third, width - third, y, y + height)
        b = whole - a
        if kind == 3:
            a, b = a * 2 * third / max(1, width - 2 * third), b
        answer = np.log((0.05 + a) / (0.05 + b))
        level = (answer > -OUTER[kind]).astype(int) + (answer > 0) + (answer > OUTER[kind])
        out |= _GRAY[level] << np.uint64(2 * k)
    heard = np.r_[0, np.cumsum(frames.any(axis=1))]
    return np.where(heard[WIDEST:] > heard[:n], out, 0).astype(np.uint32).view(np.int32)


def fingerprints(media: DataFrame, id_col: str = "id", audio: str = "audio") -> DataFrame:
    """Per row: the id and ``fp``, the array of packed integers."""
    rows = media.select(id_col, audio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, audio, 1 << 23):
            found = [packed(frames(x.as_buffer())) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], [id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp array<int>")


def _looked_up(rows: DataFrame, who: str) -> DataFrame:
    """``who, kind, pos, key``: each of the four bytes (``kind``) of integers at ``STEPS`` from a position; of a run of equal keys the first, and none that is all zero."""
    arrays = []
    for kind in range(4):
        byte = lambda x: F.shiftrightunsigned(x, 8 * kind).bitwiseAND(F.lit(0xFF))  # noqa: B023, E731
        at = lambda k, step: F.element_at("fp", (k + step + 1).cast("int"))
        places = F.when(F.size("fp") > STEPS[-1], F.sequence(F.lit(0), F.size("fp") - STEPS[-1] - 1)).otherwise(F.array().cast("array<int>"))
        keys = F.transform(places, lambda k: sum((F.shiftleft(byte(at(k, step)).cast("long"), 8 * n) for n, step in enumerate(STEPS[1:], 1)), byte(at(k, 0)).cast("long")))  # noqa: B023
        rows = rows.withColumn(f"keys_{kind}", keys)
        last = lambda k: F.when(k > 0, F.element_at(f"keys_{kind}", F.greatest(k, F.lit(1)).cast("int")))  # noqa: B023, E731
        told = F.transform(f"keys_{kind}", lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("pos"), x.alias("key"), last(k).alias("last")))  # noqa: B023
        arrays.append(F.filter(told, lambda s: (s["key"] != 0) & (s["last"].isNull() | (s["last"] != s["key"]))))
    return rows.select(who, F.explode(F.concat(*arrays)).alias("s")).select(who, "s.kind", "s.pos", "s.key")


def align(prints: DataFrame, asks: str, id_col: str = "id", most_wrong: float = 0.2, least_overlap: int = 24, least_votes: int = 2) -> DataFrame:
    """Alignments of the rows for which the SQL condition ``asks`` holds with all classes but their own.

    ``query_id, match_id`` (the class's representative), ``match_rows`` (its size), ``shift`` (the
    query's position less the match's), ``votes, overlap, bit_error``.
    """
    prints = stored(prints.select(F.col(id_col).alias("id"), "fp", F.expr(asks).alias("asks")).withColumn("mark", F.xxhash64("fp")), "prints")
    classes = prints.groupBy("mark", "fp").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = stored(classes, "classes")
    asking = stored(prints.where("asks and size(fp) > 1").select(F.col("id").alias("query_id"), "fp", "mark").join(classes.select("mark", "rep", F.col("fp").alias("f")), ["mark"]).where("fp = f").select("query_id", "fp", F.col("rep").alias("own")), "asking")
    # copies among the queries are looked up once, by their representative
    once = asking.select("own", "fp").distinct()
    hits = _looked_up(once, "own").withColumnRenamed("pos", "p").join(_looked_up(classes.where("rep is not null"), "rep"), ["kind", "key"]).where("own <> rep")
    votes = hits.groupBy("own", "rep", (F.col("p") - F.col("pos")).alias("shift")).agg(F.count("*").alias("votes"))
    # a take that begins between two frames has its votes at two offsets
    votes = votes.select("own", "rep", F.explode(F.array(F.col("shift"), F.col("shift") - 1)).alias("shift"), "votes").groupBy("own", "rep", "shift").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("own", "rep").agg(F.max(F.struct("votes", (-F.abs("shift")).alias("near"), "shift")).alias("b")).select("own", "rep", "b.shift", "b.votes").where(F.col("votes") >= least_votes)
    # of the offsets there and beside them the fewest wrong bits decide
    best = best.withColumn("shift", F.explode(F.array(*[F.col("shift") + k for k in (-1, 0, 1, 2)])))
    both = best.join(once, "own").join(classes.select("rep", F.col("fp").alias("other"), F.col("rows").alias("match_rows")), "rep")
    overlap = F.least(F.size("fp") - F.greatest("shift", F.lit(0)), F.size("other") + F.least("shift", F.lit(0)))
    both = both.withColumn("overlap", overlap).where(F.col("overlap") >= least_overlap)
    left = F.slice("fp", F.greatest("shift", F.lit(0)) + 1, F.col("overlap"))
    right = F.slice("other", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.col("overlap"))
    wrong = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, x: s + x)
    both = both.withColumn("bit_error", wrong / (F.col("overlap") * 32.0)).where(F.col("bit_error") <= most_wrong)
    least = F.min_by(F.struct("shift", "votes", "overlap", "bit_error", "match_rows"), F.struct("bit_error", F.abs("shift"), "shift")).alias("b")
    both = both.groupBy("own", "rep").agg(least).select("own", "rep", "b.*")
    return both.join(asking.select("query_id", "own"), "own").select("query_id", F.col("rep").alias("match_id"), "match_rows", "shift", "votes", "overlap", "bit_error")
