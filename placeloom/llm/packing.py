"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of the rest. Pieces of equal length share a bucket; each is a sequence of its
own, so a batch from one bucket needs no padding and no sequence holds two documents.

A very long text is packed whole; memory follows its length. Null text counts as empty: its one id is the end mark. Each repeated row is packed. Null ids stay
null. Extra columns are ignored; an empty table gives an empty result. Rows should come from files
(or a stored table), as sequence numbers follow the partitions: they are unique, not gapless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8
from .tokens import CachedTokenizer


def decompose(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and length of each piece of documents of ``totals`` ids."""
    digits = longest.bit_length() - 1
    rest = np.arange(longest)
    table = np.zeros((longest, digits), np.int64)  # set bits of each remainder, highest first
    seen = np.zeros(longest, np.int64)
    for k in reversed(range(digits)):
        has = np.flatnonzero(rest >> k & 1)
        table[has, seen[has]] = 1 << k
        seen[has] += 1
    whole, rest = totals // longest, totals % longest
    count = whole + seen[rest]
    doc = np.repeat(np.arange(len(totals)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.where(nth < whole[doc], longest, table[rest[doc], np.clip(nth - whole[doc], 0, max(0, digits - 1))]) if digits else np.ones(len(doc), np.int64)
    ends = np.cumsum(length)
    start = ends - length - np.repeat(np.r_[0, np.cumsum(totals)][:-1], count)
    return doc, start, length


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``doc_tokens``, ``bucket`` (log2 of the length), ``ids`` (little-endian unsigned 32-bit), ``sequence_id`` and ``offset``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = CachedTokenizer.of(tokenizer)
        for batch in blocks(batches, "text", keeps=("tokenizer", tokenizer)):
            ids, offsets = coder.encode(*utf8(batch.column(1)))
            n = batch.num_rows
            full = np.insert(ids.astype("<u4"), offsets[1:], end_id)
            totals = np.diff(offsets) + 1
            doc, start, length = decompose(totals, longest)
            edges = np.r_[0, np.cumsum(length)].astype(np.int64) * 4
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(full)]) if n else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(totals[doc]), pa.array(np.log2(length).astype(np.int32)), packed.cast(pa.binary())],
                [id_col, "start", "length", "doc_tokens", "bucket", "ids"],
            )

    out = rows.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, bucket int, ids binary")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces by their length, a folder to a bucket: batches of one folder need no padding."""
    packed.write.partitionBy("bucket").parquet(path)
