"""Periodic runs of words by a harmonic grid and prefix hashes.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least ``least`` and 2q words long, that no neighbouring word extends. For each period p the grid
points 0, p, 2p, ... are paired with the points p further on: n log n pairs of a text of n words in
all. Of p consecutive places with equal words p apart, which every run of period p has, one is a grid
point, so each run is met. Pairs whose words (and two more to one side) are equal go on: how far
their words agree forwards and backwards is found by binary search over prefix hashes, for all pairs
of all periods and texts of a block at once. What agrees for p words or more is a run; its words are
then compared byte by byte, and where hashes had agreed in vain the stretch is read anew. Of runs
with equal ends that of the smallest period is the run, the others are its multiples.

Null and empty texts have no run and collapse to an empty text. A very long text is searched whole,
the pairs some millions at a time; memory follows its length, some 100 bytes a byte. Repeated rows
are searched alike; null ids stay null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, blocks, powers, span_hashes, utf8

LEAST = 12
#: Pairs of grid points that are looked at at once.
PAIRS = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words, and the words before each text."""
    n_bytes, space = len(data), _SPACE[data]
    begins, stops = np.ones(n_bytes, bool), np.ones(n_bytes, bool)
    begins[1:], stops[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][filled]] = stops[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(begins & ~space), np.flatnonzero(stops & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _grid(at: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, point, period): all grid points of all periods of texts that can hold a run."""
    sizes = np.diff(at)
    texts = np.flatnonzero(sizes >= max(2, least))
    periods = sizes[texts] // 2
    first = np.cumsum(periods) - periods
    n, a = int(periods.sum()), 0
    # rows (text, period) are numbered; how many are taken at once follows from the points they have
    while a < n:
        b = min(n, a + PAIRS // 4)
        row = np.arange(a, b)
        text = np.searchsorted(first, row, "right") - 1
        period = row - first[text] + 1
        points = (sizes[texts[text]] - 1) // period
        upto = np.cumsum(points)
        take = max(1, int(np.searchsorted(upto, PAIRS, "right")))
        text, period, points, upto = text[:take], period[:take], points[:take], upto[:take]
        nth = np.arange(int(upto[-1])) - np.repeat(upto - points, points)
        p = np.repeat(period, points)
        t = np.repeat(texts[text], points)
        yield t, at[t] + nth * p, p
        a += take


class _Prefixes:
    """Hashes of any stretch of words from prefix sums."""

    def __init__(self, words: np.ndarray) -> None:
        self.up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, forwards: bool) -> np.ndarray:
        """For how many words, ``most`` at most, the text agrees after (or before) places x and y."""
        found = np.zeros(len(x), np.int64)
        for k in reversed(range(int(most.max()).bit_length() if len(most) else 0)):
            go = np.flatnonzero(found + (1 << k) <= most)
            d = found[go] + (1 << k)
            a, b = x[go], y[go]
            same = self.of(a, a + d) == self.of(b, b + d) if forwards else self.of(a - d, a) == self.of(b - d, b)
            found[go[same]] = d[same]
        return found


def find(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (text, start, end, period; starts and ends count the text's words from 0), in order, and the words."""
    starts, ends, at = words_of(data, offsets)
    n = len(starts)
    words = span_hashes(data, starts, ends)
    prefixes = _Prefixes(words)
    found = [np.zeros((0, 4), np.int64)]
    for t, x, p in _grid(at, least):
        go = np.flatnonzero(words[x] == words[x + p])
        t, x, p = t[go], x[go], p[go]
        # the place lies in p (or least - p) places in a row with equal words p apart: three at least
        if least >= 6:
            y = x + p
            right, left = np.minimum(y + 1, n - 1), np.maximum(x - 1, 0)
            right2, left2 = np.minimum(y + 2, n - 1), np.maximum(x - 2, 0)
            after = (words[right] == words[right - p]) & (words[right2] == words[right2 - p])
            before = (words[left] == words[left + p]) & (words[left2] == words[left2 + p])
            beside = (words[right] == words[right - p]) & (words[left] == words[left + p])
            go = np.flatnonzero(after | before | beside)
            t, x, p = t[go], x[go], p[go]
        if not len(x):
            continue
        y = x + p
        start = x - prefixes.agree(x, y, x - at[t], False)
        end = y + prefixes.agree(x, y, at[t + 1] - y, True)
        go = end - start >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([t[go], start[go], end[go], p[go]], axis=1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    keep, last = [], (-1, -1, -1, 0)
    bytes_of, lengths = data.tobytes(), ends - starts
    solid = np.r_[0, np.cumsum(lengths)]
    letters = b"".join([bytes_of[a:b] for a, b in zip(starts.tolist(), ends.tolist())]) if len(every) else b""
    for t, start, end, p in every.tolist():
        if last[:3] == (t, start, end) and p % last[3] == 0:
            continue  # a multiple of a period that was verified
        size = end - p - start
        same = (lengths[start : start + size] == lengths[start + p : end]).all() and letters[solid[start] : solid[start + size]] == letters[solid[start + p] : solid[end]]
        if same:
            last = (t, start, end, p)
            keep.append(last)
            continue
        equal = np.array([letters[solid[k] : solid[k + 1]] == letters[solid[k + p] : solid[k + p + 1]] for k in range(start, start + size)])
        edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
        keep += [(t, start + a, start + b + p, p) for a, b in edges.reshape(-1, 2).tolist() if b - a >= max(p, least - p)]
    runs = np.array(sorted(set(keep)), np.int64).reshape(-1, 4)
    if len(runs):
        runs = runs[np.r_[True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1)]]
        runs[:, 1:3] -= at[runs[:, 0]][:, None]
    return runs, (starts, ends, at)


def collapsed(data: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], runs: np.ndarray) -> pa.Array:
    """Each text's words, joined by a space, without those that a run has beyond its first period."""
    starts, ends, at = words
    turns = np.zeros(len(starts) + 1, np.int64)
    if len(runs):
        np.add.at(turns, at[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(turns, at[runs[:, 0]] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(turns)[:-1] == 0)
    before = np.searchsorted(kept, at)
    sizes = ends[kept] - starts[kept] + 1
    closing = before[1:][before[1:] > before[:-1]] - 1  # a text's last word has no space after it
    sizes[closing] -= 1
    upto = np.r_[0, np.cumsum(sizes)]
    from_byte = np.repeat(starts[kept] - upto[:-1], sizes) + np.arange(upto[-1])
    out = data[np.minimum(from_byte, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
    spaces = np.ones(len(kept), bool)
    spaces[closing] = False
    out[upto[1:][spaces] - 1] = 0x20
    edges = upto[before].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(edges), pa.py_buffer(out)).cast(pa.string())


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: the id, ``runs`` (array of start, length and period, by start, then period) and the ``collapsed`` text."""
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            data, offsets = utf8(batch.column(1))
            found, words = find(data, offsets, least)
            found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
            edges = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), each), collapsed(data, words, found)], [id_col, "runs", "collapsed"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(found: Column) -> Column:
    """The run of greatest length; of those the first, then that of the least period. Null without runs."""
    ranked = F.transform(found, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))
    return F.array_min(ranked)


def looped(text: Column, begin: Column, period: Column) -> Column:
    """The text whose words from word ``begin`` on repeat the ``period`` words there, joined by a space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    place = lambda x, i: F.when(i < x["begin"], i).otherwise(x["begin"] + F.pmod(i - x["begin"], x["period"])).cast("int")
    joined = lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(x["words"]).cast("long") - 1), lambda i: F.get(x["words"], place(x, i))), " ")
    # bound by an outer array of one, as what a lambda refers to is evaluated for each element
    bound = F.array(F.struct(words.alias("words"), begin.alias("begin"), period.alias("period")))
    return F.get(F.transform(bound, lambda x: F.when(F.size(x["words"]) > 0, joined(x)).otherwise(text)), F.lit(0))
