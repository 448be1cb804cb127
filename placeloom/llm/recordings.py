"""Recordings made from table rows, for a media column where a corpus has none.

Four rows in a row are takes of one tune: excerpts from different places, each with its own timbre
(from the row's numbers), loudness and noise.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 4000
TAKES = 4
NOTE, LENGTH, STEP = 0.25, 5.0, 0.5


def tune(work: int) -> np.ndarray:
    """Frequencies of two voices, a note each quarter second."""
    rng = np.random.default_rng(zlib.crc32(str(work).encode()))
    notes = int((LENGTH + STEP * TAKES) / NOTE) + 1
    return 110.0 * 2.0 ** (rng.integers(0, 30, (2, notes)) / 12)


def recording(row: int, numbers: np.ndarray) -> bytes:
    """WAV bytes of one take, 8 bits a sample."""
    work, take = divmod(row, TAKES)
    rng = np.random.default_rng(row)
    at = take * STEP + np.arange(int(LENGTH * RATE)) / RATE
    own = np.abs(np.resize(numbers if len(numbers) else np.zeros(1), 3)) + 0.05
    weights = np.array([1.0, 0.3, 0.15]) * (0.7 + 0.6 * own / own.sum())
    out = np.zeros(len(at))
    for voice, volume in zip(tune(work), (1.0, 0.7)):
        phase = 2 * np.pi * np.cumsum(voice[(at / NOTE).astype(int)]) / RATE
        for k, w in enumerate(weights, start=1):
            out += volume * w * np.sin(k * phase)
    out = out / np.abs(out).max() * rng.uniform(0.5, 0.9) + rng.normal(0, 0.01, len(out))
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes((np.clip(out, -1, 1) * 127 + 128).astype(np.uint8).tobytes())
    return buffer.getvalue()


def recordings(rows: DataFrame, id_col: str = "vec_id", numbers: str = "embedding") -> DataFrame:
    """Per row: ``id`` and ``audio``."""
    rows = rows.select(id_col, numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [None if i is None else recording(i, np.array(x or [], np.float64)) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(made, pa.binary())], ["id", "audio"])

    return rows.mapInArrow(run, "id long, audio binary")
