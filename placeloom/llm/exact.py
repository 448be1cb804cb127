"""Exact dedup by counting quotient filters and byte verification.

Each partition's fingerprints go into counting quotient filters, one for each range of
fingerprints (a segment). A filter splits a fingerprint into a quotient, which is implied by the
place of its run, and a remainder, which is stored sorted in the run; a remainder met more than once
is followed by counter slots. Filters of one segment merge without loss, as their runs are sorted:
the merged one is what one filter over all rows would be, whatever the geometry of the parts. Only
texts whose fingerprint has a count above one go on, and these are grouped by their bytes. So equal
fingerprints of unlike texts do no harm, and texts met once are never shuffled.

A partition sends one slot for a fingerprint however often it met it, and one copy of a text however
often it met that, so a hot text costs a row a partition. Segments grow in number with the rows and
stay bounded in size. The bitmap that routes texts has a fixed largest size; where it says yes in
vain, grouping finds a group of one.

Null texts count as empty, and empty texts are equal to one another. Null ids come last: a group
keeps a null id only if it has no other. Rows that repeat an id and text are a group like any other,
of which exactly one stays. A very long text is handled whole. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, small, stored

#: Fingerprints of a segment, about; and segments at least, as powers of two.
SEGMENT, LEAST_SEGMENTS = 19, 8
#: Distinct fingerprints that a task gathers before it writes its filters.
GATHERED = 1 << 21
#: Most bits of the bitmap that routes texts.
ROUTE_BITS = 1 << 27

FILTER = "segment int, quotient_bits int, remainder_bits int, slots long, occupied binary, run_end binary, counter binary, remainders binary"


@dataclass
class QuotientFilter:
    """Counts of fingerprints of ``quotient_bits + remainder_bits`` bits, in sorted runs.

    ``occupied`` has a bit for each quotient with a run. Slots lie in the order of quotients; ``run_end``
    marks the last slot of a run, and ``counter`` slots hold the digits of the count, less one, of the
    remainder before them, lowest first.
    """

    quotient_bits: int
    remainder_bits: int
    slots: int
    occupied: np.ndarray
    run_end: np.ndarray
    counter: np.ndarray
    remainders: np.ndarray

    @staticmethod
    def of(prints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From distinct sorted fingerprints of ``bits`` bits; about one quotient for each."""
        q = min(bits, max(1, int(len(prints)).bit_length()))
        r = bits - q
        mask = np.uint64((1 << r) - 1) if r else np.uint64(0)
        quotient, rest = prints >> np.uint64(r) if r < 64 else np.zeros_like(prints), prints & mask
        digit_bits = max(r, 1)
        left = (counts - 1).astype(np.uint64)
        digits = np.zeros(len(prints), np.int64)
        more = left.copy()
        while more.any():
            digits += more > 0
            more = more >> np.uint64(digit_bits) if digit_bits < 64 else np.zeros_like(more)
        ends = np.cumsum(1 + digits)
        begins = ends - 1 - digits
        slots = int(ends[-1]) if len(ends) else 0
        remainders, counter, run_end = np.zeros(slots, np.uint64), np.zeros(slots, bool), np.zeros(slots, bool)
        remainders[begins] = rest
        for k in range(int(digits.max()) if len(digits) else 0):
            has = np.flatnonzero(digits > k)
            remainders[begins[has] + 1 + k] = left[has] & np.uint64((1 << digit_bits) - 1)
            left[has] = left[has] >> np.uint64(digit_bits) if digit_bits < 64 else 0
            counter[begins[has] + 1 + k] = True
        if slots:
            run_end[ends[np.r_[quotient[1:] != quotient[:-1], True]] - 1] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if 8 * np.dtype(t).itemsize >= digit_bits)
        return QuotientFilter(q, r, slots, np.packbits(occupied), np.packbits(run_end), np.packbits(counter), remainders.astype(kind))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, with their counts."""
        n = self.slots
        counter, run_end = np.unpackbits(self.counter, count=n).astype(bool), np.unpackbits(self.run_end, count=n).astype(bool)
        quotients = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        run = np.cumsum(run_end) - run_end
        at = np.flatnonzero(~counter)
        prints = quotients[run[at]] << np.uint64(self.remainder_bits) | self.remainders[at].astype(np.uint64)
        counts = np.ones(len(at), np.int64)
        digit = np.flatnonzero(counter)
        if len(digit):
            owner = np.searchsorted(at, digit) - 1
            shift = (digit - at[owner] - 1) * max(self.remainder_bits, 1)
            np.add.at(counts, owner, self.remainders[digit].astype(np.int64) << shift)
        return prints, counts

    def row(self, segment: int) -> tuple:
        return (segment, self.quotient_bits, self.remainder_bits, self.slots, self.occupied.tobytes(), self.run_end.tobytes(), self.counter.tobytes(), self.remainders.tobytes())

    @staticmethod
    def from_row(r: dict) -> QuotientFilter:
        digit_bits = max(r["remainder_bits"], 1)
        kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if 8 * np.dtype(t).itemsize >= digit_bits)
        bits = (np.frombuffer(r[c], np.uint8) for c in ("occupied", "run_end", "counter"))
        return QuotientFilter(r["quotient_bits"], r["remainder_bits"], r["slots"], *bits, np.frombuffer(r["remainders"], kind))


def merged(filters: list[QuotientFilter], bits: int) -> QuotientFilter:
    """One filter with the counts of all; equal fingerprints meet, as all runs are sorted."""
    parts = [f.counts() for f in filters]
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")  # merges sorted runs
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
    return QuotientFilter.of(prints[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in FILTER.split(", ")])


def filters(prints: DataFrame, column: str, bits: int, segment_bits: int) -> DataFrame:
    """Counting quotient filters of each partition (``FILTER``), one for each segment that it met."""
    low = bits - segment_bits

    def write(found: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        segment = (found >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(found), np.int64)
        turns = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        mask, rows, size = np.uint64((1 << low) - 1), [], 0
        for a, b in zip(turns, np.r_[turns[1:], len(found)]):
            rows.append(QuotientFilter.of(found[a:b] & mask, counts[a:b], low).row(int(segment[a])))
            size += 16 * int(b - a)
            if size > 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def gather() -> tuple[np.ndarray, np.ndarray]:
            every, times = (np.concatenate(x) for x in zip(*parts))
            found, inverse = np.unique(every, return_inverse=True)
            return found, np.bincount(inverse, weights=times, minlength=len(found)).astype(np.int64)

        for batch in batches:
            if batch.num_rows:
                parts.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
                held += len(parts[-1][0])
                if held > GATHERED:
                    parts[:] = [gather()]
                    held = len(parts[0][0])
                    if held > GATHERED // 2:
                        yield from write(*parts.pop())
                        held = 0
        if parts:
            yield from write(*gather())

    return prints.select(column).mapInArrow(run, FILTER)


def merge(parts: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """One filter a segment, from those of the partitions."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_batches([_batch([merged([QuotientFilter.from_row(r) for r in rows], bits - segment_bits).row(rows[0]["segment"])])])

    return parts.groupBy("segment").applyInArrow(run, FILTER)


def counted(whole: DataFrame, least: int = 1) -> DataFrame:
    """``(fp, count)`` of the fingerprints that filters hold at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = QuotientFilter.from_row(r)
                prints, counts = f.counts()
                prints, counts = prints[counts >= least], counts[counts >= least]
                prints = prints | np.uint64(r["segment"] << (f.quotient_bits + f.remainder_bits))
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts)], ["fp", "count"])

    return whole.mapInArrow(run, "fp long, count long")


def group_equal(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Per row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``bits`` is the size of a fingerprint; fewer send more unlike texts to the comparison of bytes, and
    change no result. Groups of texts are told apart by fingerprint and SHA-256 once their bytes were compared.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    fp = F.shiftrightunsigned(F.xxhash64(body), 64 - bits) if bits < 64 else F.xxhash64(body)
    rows = docs.select(F.col(id_col).alias("id"), fp.alias("fp"), F.unhex(F.sha2(body, 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "exact-rows")
    segment_bits = min(bits - 1, max(LEAST_SEGMENTS, rows.count().bit_length() - SEGMENT))
    whole = stored(merge(filters(rows, "fp", bits, segment_bits), bits, segment_bits), "exact-filters")
    again = stored(counted(whole, 2), "exact-again")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(again, "fp", again.count(), ROUTE_BITS))

    @F.pandas_udf("boolean")
    def routed(prints: pd.Series) -> pd.Series:
        bits_of = shared.value
        at = prints.to_numpy().astype(np.int64) & (8 * len(bits_of) - 1)
        return pd.Series(bits_of[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)

    equal = docs.select(F.col(id_col).alias("id"), body.alias("body"), fp.alias("fp")).where(routed("fp")).groupBy("fp", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    groups = small(stored(equal.where("size > 1").select("fp", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "size"), "exact-groups"))
    same = [F.col("r.fp") == F.col("g.fp"), F.col("r.sha") == F.col("g.sha")]
    stays = rows.alias("r").join(groups.alias("g"), [*same, F.col("r.id").eqNullSafe(F.col("g.keep_id"))]).groupBy("g.fp", "g.sha", "keep_id", "size").agg(F.min("r.row").alias("keep_row"))
    stays = small(stored(stays, "exact-stays"))
    out = rows.alias("r").join(stays.alias("g"), same, "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        F.col("r.id").alias(id_col), F.when(alone, F.col("r.id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("r.row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("r.sha")).alias("text_sha256"),
    )
