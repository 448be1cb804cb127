"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from placeloom.llm import simhash
from placeloom.llm.components import components
from placeloom.llm.queries import QUERIES


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps: list[int], limit: int = 3) -> list[int]:
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps)
    want = sorted(((d, f"{fps[k]:016x}", docs[roots[k]][0]) for k, (d, _) in enumerate(docs)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == want


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect(), docs)


def test_edges(edges, clashing, nothing):
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = simhash.near_duplicates(clashing).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) fingerprint", "component_id").collect()
    check(got, docs)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limit", [1, 3])
def test_links_of_crowded_buckets(spark, limit):
    """Fingerprints in clusters, some larger than a block: the components are those of all pairs."""
    rng = random.Random(limit)
    fps = set()
    for size in (1, 2, 30, 150):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(150)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3).cache()
    roots = {r["u"]: r["v"] for r in components(simhash.links(nodes, limit, block_rows=20), "a", "b").collect()}
    want = plain_components(fps, limit)
    groups: dict = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_plans_find_every_link():
    """For any plan and any pair within the limit some partition is within its threshold."""
    rng = random.Random(1)
    sample = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    for total in (1000, 10**6, 10**9, 3 * 10**10):
        parts = simhash.plan(sample, total, 3)
        assert sum(p.threshold + 1 for p in parts) == 4
        assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(bin(flips & p.mask).count("1") <= p.threshold for p in parts)
    assert len(simhash.plan(sample, 1000, 3)) > len(simhash.plan(sample, 3 * 10**10, 3))
    assert max(p.threshold for p in simhash.plan(sample[:0], 0, 3)) == 0


def test_one_of_each_group_is_kept(edges, clashing, nothing):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = edges.collect()
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(plain_components([plain_fingerprint(r["text"]) for r in rows])))
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and ids.count(14) == 1
    assert simhash.keep_one(nothing).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (5, 5), (None, 1), (9, 8), (4, 1)] + [(k, k + 1) for k in range(20, 32)], "a long, b long")
    got = {r["u"]: r["v"] for r in components(edges, "a", "b").collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8} | {k: 20 for k in range(21, 33)}
    assert components(edges.where("false"), "a", "b").count() == 0
