"""Groups for ``simhash.keep_one`` with a similarity: exact Jaccard similarity of word shingles, with candidates from fingerprints and, beyond their reach, from MinHash bands.

A text is the set of its shingles of five words (a shorter text is one shingle). Texts of equal sets
are one node. Nodes that agree in all minima of a band are candidates: at a similarity of 0.8 a pair
misses all 16 bands of 4 minima with probability 0.0002. Only pairs whose exact similarity reaches
the limit are linked. First each candidate is compared with the first set of its group, so a large
group of near copies costs a comparison a copy; only candidates that differ from it are then compared
with the others of their group, in blocks that tasks of their own take in pairs.

SimHash comes first: sets whose fingerprints ``simhash.links`` joins within ``limit`` bits are candidates
too, compared exactly pair by pair. Bands add what lies further apart.

Null and word-less texts are one node. A very long text is compared whole; memory follows its
length, some 60 bytes a byte. Repeated rows keep their rows. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bitmap, blocks, mix64, small, span_hashes, stored, utf8
from .components import components

BANDS, MINIMA = 16, 4
#: Shingles and sets that a block holds; groups beyond that are compared in pairs of blocks.
BLOCK_SHINGLES, BLOCK_ROWS = 2_000_000, 2048
#: Most bits of the filter that keeps sets without candidates from being shuffled.
FILTER_BITS = 1 << 27

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TURN = np.uint64(0x2545F4914F6CDD1D)
_SEEDS = mix64(np.arange(1, 2 * BANDS * MINIMA + 1, dtype=np.uint64) * _TURN).reshape(-1, 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and where each text's begin and end."""
    docs, n_bytes = len(offsets) - 1, len(data)
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    space = _SPACE[data]
    begins, stops = np.ones(n_bytes, bool), np.ones(n_bytes, bool)
    begins[1:], stops[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][filled]] = stops[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(begins & ~space), np.flatnonzero(stops & ~space) + 1
    n, at = len(starts), np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(docs), np.diff(at))
    size = np.minimum(np.diff(at), shingle)[doc]
    begin = np.flatnonzero(np.arange(n) + size <= at[1:][doc])
    words, size, doc = span_hashes(data, starts, ends), size[begin], doc[begin]
    keys = size.astype(np.uint64)
    for j in range(shingle):
        more = (keys + words[np.minimum(begin + j, n - 1)]) * _TURN
        keys = np.where(j < size, more ^ (more >> np.uint64(29)), keys)
    keys = mix64(keys)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])] if len(keys) else np.zeros(0, bool)
    return keys[first], np.searchsorted(doc[first], np.arange(docs + 1))


def set_keys(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out, filled = np.zeros(len(bounds) - 1, np.uint64), bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = mix64(np.add.reduceat(mix64(keys), bounds[:-1][filled]) + np.diff(bounds)[filled].astype(np.uint64))
    return out


def bands(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The band keys of each set, a row each; sets must not be empty."""
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(out), b + 1, np.uint64)
        for seed, odd in _SEEDS[b * MINIMA : (b + 1) * MINIMA]:
            least = np.minimum.reduceat((keys ^ seed) * (odd | np.uint64(1)), bounds[:-1]) if len(out) else key
            key = (key ^ least) * _TURN
            key ^= key >> np.uint64(29)
        out[:, b] = mix64(key)
    return out


def _forest(sets: list[np.ndarray], least: float, joined: list[bool]) -> list[tuple[int, int]]:
    """Links that join what pairs of candidates with a similarity of ``least`` or more join; those marked are joined already."""
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
    found, sizes = bands(np.concatenate(sets), bounds), np.diff(bounds)
    parent, out, unlike = np.arange(len(sets)), [], set()
    if any(joined):
        parent[joined] = joined.index(True)

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(BANDS):
        order = np.argsort(found[:, b], kind="stable")
        ranked = found[order, b]
        turn = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        many = np.diff(np.r_[turn, len(order)])
        end = np.repeat(turn + many, many)
        active, step, changed = np.arange(len(order)), 1, True
        while True:
            active = active[active + step < end[active]]
            if changed:  # buckets that are joined have nothing to add
                while (parent != (up := parent[parent])).any():
                    parent = up
                apart = np.minimum.reduceat(parent[order], turn) < np.maximum.reduceat(parent[order], turn)
                active, changed = active[np.repeat(apart, many)[active]], False
            if not len(active):
                break
            x, y = order[active], order[active + step]
            like = (parent[x] != parent[y]) & (np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y]) - 1e-6)
            for i, j in zip(x[like].tolist(), y[like].tolist()):
                pair, i_top, j_top = (min(i, j), max(i, j)), top(i), top(j)
                if i_top == j_top or pair in unlike:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common / (sizes[i] + sizes[j] - common) >= least:
                    parent[max(i_top, j_top)], changed = min(i_top, j_top), True
                    out.append(pair)
                else:
                    unlike.add(pair)
            step += 1
    return out


def fingerprint_pairs(sets: DataFrame, limit: int) -> DataFrame:
    """``(a, b)``: candidates among sets (``set_key, fp``), those of one fingerprint and those that SimHash links within ``limit`` bits."""
    sets = stored(sets.distinct(), "set-fingerprints")
    nodes = stored(sets.groupBy("fp").agg(F.min("set_key").alias("first")), "set-nodes")
    same = sets.join(small(nodes), "fp").select(F.col("set_key").alias("a"), F.col("first").alias("b"))
    linked = stored(simhash.links(nodes, limit), "fingerprint-links")
    near = linked.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stored(same.unionByName(near).where("a <> b").distinct(), "fingerprint-pairs")


def _links(docs: DataFrame, groups: DataFrame, pairs: DataFrame, least: float, shingle: int, block_shingles: int, block_rows: int) -> DataFrame:
    """``(a, b)``: links between sets of the same group and of ``pairs``; ``groups`` has each candidate's ``set_key`` and ``group``."""
    paired = stored(pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct(), "paired-sets")
    alone = paired.join(groups.select("set_key"), "set_key", "left_anti").select("set_key", F.col("set_key").alias("group"))
    groups = stored(groups.unionByName(alone), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(groups, "set_key", groups.count(), FILTER_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, set()
        for batch in blocks(batches, "text"):
            keys, bounds = shingle_sets(*utf8(batch.column(0)), shingle)
            own = set_keys(keys, bounds)
            place = own & np.uint64(8 * len(bitmap) - 1)
            hit = np.flatnonzero((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            new = [k for k in hit.tolist() if bounds[k] < bounds[k + 1] and not (own[k] in seen or seen.add(own[k]))]
            if new:
                flat = np.concatenate([keys[bounds[k] : bounds[k + 1]] for k in new]).view(np.int64)
                grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.diff(bounds)[new])].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(own[new].view(np.int64)), pa.array(np.diff(bounds)[new].astype(np.int64)), grams], ["set_key", "n", "grams"])

    rows = stored(docs.select("text").mapInArrow(sets, "set_key long, n long, grams array<long>").join(small(groups), "set_key"), "candidate-sets")
    # stored, so that the join reads plain shuffles, of which adaptive execution splits a hot group's
    first = stored(rows.where("set_key = `group`").groupBy("group").agg(F.first("n").alias("first_n"), F.first("grams").alias("first_grams")), "first-sets")
    common = F.size(F.array_intersect("grams", "first_grams"))
    like = common >= F.lit(least) * (F.col("n") + F.col("first_n") - common)
    checked = stored(rows.join(first, "group").select("set_key", "group", "n", like.alias("like")), "checked-sets")
    star = checked.where("like and set_key <> `group`").select(F.col("set_key").alias("a"), F.col("group").alias("b"))
    ends = stored(rows.join(small(paired), "set_key").groupBy("set_key").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "paired-grams")
    met = pairs.join(ends.withColumnRenamed("set_key", "a"), "a").join(ends.toDF("b", "first_n", "first_grams"), "b")
    star = star.unionByName(met.where(like).select("a", "b"))

    # groups with sets that are unlike their first: each of these meets all others, in blocks of like (side 0) and unlike sets (side 1)
    cut = lambda own: F.greatest(F.ceil(F.sum(F.when(own, F.col("n"))) / block_shingles), F.ceil(F.count_if(own) / block_rows)).cast("int")
    cuts = checked.groupBy("group").agg(cut(F.col("like")).alias("like_cuts"), cut(~F.col("like")).alias("cuts")).where("cuts > 0")
    open_sets = checked.join(small(stored(cuts, "cuts")), "group").select("set_key", "like", "like_cuts", "cuts").distinct()
    work = rows.join(small(stored(open_sets, "open-sets")), "set_key")
    place = F.pmod(F.xxhash64("set_key", F.lit("cut")), F.when(F.col("like"), F.col("like_cuts")).otherwise(F.col("cuts"))).cast("int")
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.filter(every(F.col("cuts")), lambda x: x != F.col("place"))
    meets = F.when(F.col("like"), F.transform(every(F.col("cuts")), lambda j: task(0, F.col("place"), j))).otherwise(
        F.concat(F.transform(every(F.col("like_cuts")), lambda i: task(0, i, F.col("place"))), F.transform(others, lambda x: task(1, F.least(F.col("place"), x), F.greatest(F.col("place"), x))))
    )
    work = work.withColumn("place", place).withColumn("task", F.explode(meets)).select("group", "task.*", "set_key", "like", "grams")
    dealt = work.repartition("group", "kind", "i", "j").sortWithinPartitions("group", "kind", "i", "j", "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: dict[int, tuple[np.ndarray, bool]] = {}

        def found() -> pa.RecordBatch:
            names = list(held)
            links = _forest([g for g, _ in held.values()], least, [x for _, x in held.values()]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in links], pa.int64()), pa.array([names[y] for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            grams = batch.column(6)
            flat, off = grams.flatten().to_numpy().view(np.uint64), np.asarray(grams.offsets)
            off = off - off[0] if len(off) else off
            for n, (*now, key, joined) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]))):
                if at != tuple(now):
                    if len(held) > 1:
                        yield found()
                    at, held = tuple(now), {}
                held[key] = flat[off[n] : off[n + 1]], joined
        yield found()

    return star.unionByName(dealt.mapInArrow(run, "a long, b long"))


def near_groups(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS, limit: int = 3) -> DataFrame:
    """Per row of ``docs``: the id, ``text_hash`` (Spark's xxhash64 of the text) and ``root``, one for all texts that chains of similar pairs join."""
    texts = docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            data, offsets = utf8(batch.column(2))
            raw, at = data.tobytes(), offsets.tolist()
            fps = np.array([simhash.fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])], np.uint64)
            keys, bounds = shingle_sets(data, offsets, shingle)
            own, filled = set_keys(keys, bounds), bounds[1:] > bounds[:-1]
            flat = bands(keys, np.r_[bounds[:-1][filled], len(keys)]).ravel().view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(filled * BANDS)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.view(np.int64)), pa.array(fps.view(np.int64)), listed], [id_col, "text_hash", "set_key", "fp", "bands"])

    marked = stored(texts.mapInArrow(run, f"`{id_col}` {kind}, text_hash long, set_key long, fp long, bands array<long>"), "sets")
    pairs = fingerprint_pairs(marked.where("size(bands) > 0").select("set_key", "fp"), limit)
    rows = marked.select("set_key", F.explode("bands").alias("band"))
    shared = stored(rows.groupBy("band").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first < last").select("band", "first"), "shared-bands")
    tied = components(rows.join(small(shared), "band").select("set_key", "first"), "set_key", "first")
    groups = stored(tied.select(F.col("u").alias("set_key"), F.col("v").alias("group")).unionByName(tied.select(F.col("v").alias("set_key"), F.col("v").alias("group")).distinct()), "groups")
    roots = components(_links(texts, groups, pairs, least, shingle, block_shingles, block_rows), "a", "b").select(F.col("u").alias("set_key"), F.col("v").alias("root"))
    return marked.select(id_col, "text_hash", "set_key").join(small(roots), "set_key", "left").select(id_col, "text_hash", F.coalesce("root", "set_key").alias("root"))
