"""SimHash near-duplicates by the generalised pigeonhole principle.

If two 64-bit fingerprints differ in at most ``limit`` bits and the bits are cut into partitions
whose thresholds t satisfy sum(t + 1) = limit + 1, some partition differs in at most t bits. Bits
that vary together go into one partition; dynamic programming gives the partitions unequal
thresholds, by the candidates that a sample of fingerprints lets expect at the true number of
them. A partition of threshold t is probed with all keys within t bits. Verified links are reduced
to a spanning forest in each bucket, so a dense bucket doesn't emit its pairs.

Null and word-less texts have fingerprint 0 and link like any other. A very long text is
fingerprinted whole; memory follows its length, some 30 bytes a byte. Repeated rows keep their rows;
null ids take part but are never a component's id (a component of null ids has a null id). Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, small, stored, utf8
from .components import components

#: Fingerprints that the partitioning is fitted on, at about this number.
SAMPLE = 20_000
#: Rows of a bucket that one task compares with one another; larger buckets are compared in blocks.
BLOCK_ROWS = 4096
#: Cost of a row that is dealt out, in comparisons.
ROW_COST = 200.0

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned SimHash of one text's word shingles (repeats count)."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.bincount((each + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` and the fingerprint, as a signed long."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            data, offsets = utf8(batch.column(text))
            raw, off = data.tobytes(), offsets.tolist()
            found = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off, off[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _equal_pairs(keys: np.ndarray) -> float:
    n = np.unique(keys, return_counts=True)[1].astype(float)
    return float((n * (n - 1) / 2).sum())


def _grouped(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal width; each group takes the bits that correlate most with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0) if len(sample) else 0.0
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    corr = np.abs(bits.T @ bits) / np.outer(norm, norm)
    left, groups = list(range(64)), []
    for k in range(parts):
        group = [left.pop(0)]
        while len(group) < 64 // parts + (k < 64 % parts):
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _costs(sample: np.ndarray, bits: list[int], total: int, most: int) -> list[float]:
    """Expected cost of thresholds -1, 0, 1 ... of a partition over ``total`` fingerprints."""
    width, pairs = len(bits), max(1.0, len(sample) * (len(sample) - 1) / 2)
    keys = sample & np.uint64(sum(1 << b for b in bits))
    equal = _equal_pairs(keys) / pairs
    near = [equal]
    if most >= 1:
        near.append(max(equal, sum(_equal_pairs(keys & ~np.uint64(1 << b)) for b in bits) / pairs - (width - 1) * equal))
    while len(near) <= most:  # the rest by the ratio of a uniform partition
        near.append(near[-1] * max(1.0, comb(width, len(near)) / comb(width, len(near) - 1)))
    out = [0.0]
    for t in range(most + 1):
        rows = sum(comb(width, k) for k in range(t + 1))
        share = max(near[t], rows / 2.0**width)
        out.append(ROW_COST * rows * total + share * total * total / 2)
    return out


def plan(sample: np.ndarray, total: int, limit: int = 3) -> list[Partition]:
    """The cheapest partitions and thresholds for ``total`` fingerprints, with sum(t + 1) = limit + 1."""
    if limit < 0 or limit > 8:
        raise ValueError("limit must lie between 0 and 8 bits")
    total = max(total, 2)  # an empty table costs nothing under any plan
    best: tuple[float, list[Partition]] | None = None
    for parts in range(1, limit + 2):
        groups = _grouped(sample, parts)
        # state: what is spent of limit + 1 -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            costs = _costs(sample, bits, total, min(limit, 3))
            states_next: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, taken) in states.items():
                for t, extra in enumerate(costs, start=-1):
                    at = spent + t + 1
                    if at <= limit + 1 and (at not in states_next or cost + extra < states_next[at][0]):
                        states_next[at] = (cost + extra, [*taken, t])
            states = states_next
        if limit + 1 in states and (best is None or states[limit + 1][0] < best[0]):
            best = states[limit + 1][0], [Partition(tuple(b), t) for b, t in zip(groups, states[limit + 1][1]) if t >= 0]
    assert best is not None
    return best[1]


def _forest(fps: np.ndarray, probe: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) of the rows ``i`` < ``j`` < ``end[i]`` that differ in at most ``limit`` bits; two probes aren't compared."""
    parent = np.arange(len(fps))
    active, step = np.arange(len(fps)), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            break
        other = active + step
        hit = (np.bitwise_count(fps[active] ^ fps[other]) <= limit) & ~(probe[active] & probe[other])
        a, b = active[hit], other[hit]
        new = parent[a] != parent[b]
        if new.any():
            for x, y in zip(a[new].tolist(), b[new].tolist()):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
            while (parent != (up := parent[parent])).any():
                parent = up
        step += 1
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return child, parent[child]


def links(nodes: DataFrame, limit: int = 3, fp: str = "fp", block_rows: int = BLOCK_ROWS, partitions: list[Partition] | None = None) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that join what ``limit`` bits join, a spanning forest in each bucket.

    ``nodes`` must be stored and have one row per fingerprint.
    """
    total = nodes.count()
    if partitions is None:
        share = min(1.0, SAMPLE / max(1, total))
        below = min(2**63 - 1, int(-(2**63) + share * 2.0**64))
        chosen = nodes.where(F.xxhash64(fp, F.lit("sample")) <= F.lit(below)).select(fp)
        sample = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)
        partitions = plan(sample, total, limit)
    slots = []
    for k, part in enumerate(partitions):
        key = F.col(fp).bitwiseAND(F.lit(_signed(part.mask)))
        for t in range(part.threshold + 1):
            for flips in combinations(part.bits, t):
                slots.append(F.struct(F.lit(k).alias("part"), key.bitwiseXOR(F.lit(_signed(sum(1 << b for b in flips)))).alias("key"), F.lit(t > 0).alias("probe")))
    rows = nodes.select(F.col(fp).alias("fp"), F.explode(F.array(*slots)).alias("slot")).select("fp", "slot.*")
    crowded = stored(rows.groupBy("part", "key").count().where(F.col("count") > block_rows), "crowded")
    crowded = small(crowded.select("part", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("cuts")))
    # A crowded bucket is cut into blocks; each pair of blocks is compared in a task of its own.
    rows = rows.join(crowded, ["part", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("fp", F.lit("cut")), F.col("cuts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0, cuts - 1)")))
    rows = rows.select("part", "key", F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j"), "fp", "probe")
    dealt = rows.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            part, key, i, j, fps, probe = cols
            turn = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            sizes = np.diff(np.r_[turn, len(fps)])
            child, root = _forest(fps.view(np.uint64), probe, np.repeat(turn + sizes, sizes), limit)
            return pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            # the last bucket may go on in the next batch
            same = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                same &= c == c[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield found([c[:cut] for c in cols])
            kept = [c[cut:] for c in cols]
        if kept is not None:
            yield found(kept)

    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, limit: int = 3, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: the id, ``text_hash`` (Spark's xxhash64 of the text), ``fp``, ``root`` (least linked fingerprint) and ``component_id``."""
    marked = docs.select(F.col(id_col), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = stored(with_fingerprints(marked, "text", "fp", shingle).drop("text"), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(nodes, limit), "a", "b").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = stored(nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(nodes.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, limit: int = 3, id_col: str = "doc_id", text: str = "text", similarity: float | None = None, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` per group, all columns: that of the least id (of repeated ids, the least text hash; of repeated rows, any).

    Groups are what ``limit`` bits of the fingerprints link. With ``similarity`` they are what that Jaccard similarity of the
    sets of shingles links, by exact comparison: candidates are what ``limit`` bits link and, as at 0.8 such texts lie up to 17
    bits apart, which no partition of 64 bits can be probed for, what ``minhash`` adds.
    """
    if similarity is None:
        return keep_of_groups(docs, near_duplicates(docs, limit, id_col, text, shingle), id_col, text)
    from .minhash import near_groups

    return keep_of_groups(docs, near_groups(docs, similarity, shingle, id_col, text, limit=limit), id_col, text)


def keep_of_groups(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row that stands for each ``root`` of ``found``, which has id, ``text_hash`` and ``root`` of each row.

    All is decided on narrow rows; the texts are shuffled once, in the join with the kept keys. Rows that are
    repeated with id and text are reduced to one before they are shuffled, so none of them is a hot key.
    """
    key, mark, rows = (fresh(docs.columns, c) for c in ("kept_id", "text_mark", "row"))
    keyed = found.groupBy("root", F.struct(F.col(id_col)).alias("k"), "text_hash").agg((F.count("*") > 1).alias("many"))  # a struct equals another with a null
    least = F.min(F.struct(F.col(f"k.`{id_col}`").isNull().alias("n"), "k", "text_hash", "many")).alias("b")
    best = stored(keyed.groupBy("root").agg(least).select(F.col("b.k").alias(key), F.col("b.text_hash").alias(mark), "b.many"), "kept")
    docs = docs.select(F.struct(F.col(id_col)).alias(key), F.xxhash64(text).alias(mark), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(rows))
    single = docs.join(best.where("not many").select(key, mark), [key, mark]).select(rows)
    repeated = docs.join(small(best.where("many").select(key, mark)), [key, mark], "left_semi").groupBy(key, mark).agg(F.first(rows).alias(rows)).select(rows)
    return single.unionByName(repeated).select(f"`{rows}`.*")
