"""Shards: groups stay together, near-equal bytes, gapless slots."""

from __future__ import annotations

import zlib
from collections import defaultdict

from placeloom.llm import sharding
from placeloom.llm.queries import QUERIES


def check(rows, texts, shards=8, slack=None):
    load, slots, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots:
        assert 0 <= s < shards and sorted(slots[s]) == list(range(len(slots[s])))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc, text in texts:
        body = (text or "").encode()
        hit = next(r for r in by[doc] if r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body))
        by[doc].remove(hit)
        assert where.setdefault(body, hit["shard"]) == hit["shard"]
    assert not any(by.values())
    if slack is not None:
        assert max(load[s] for s in range(shards)) - min(load[s] for s in range(shards)) <= slack
    return load


def test_schedule_is_longest_first():
    assert sharding.schedule([7, 7, 6, 5, 4], 2) == [0, 1, 0, 1, 1]
    assert sharding.schedule([], 3) == []
    sizes = [9, 8, 8, 3, 3, 2, 2, 1]
    to = sharding.schedule(sizes, 3)
    loads = [sum(s for s, t in zip(sizes, to) if t == k) for k in range(3)]
    assert max(loads) <= 4 / 3 * max(max(sizes), sum(sizes) / 3)


def test_edges(edges, clashing, nothing):
    texts = [(r["doc_id"], r["text"]) for r in edges.collect()]
    check(sharding.shard(edges).collect(), texts)
    check(sharding.shard(clashing, 3).collect(), texts, 3)
    assert sharding.shard(nothing).count() == 0


def test_bundles_are_near_equal(spark):
    rows = [(k, "w" * (1 + k % 50)) for k in range(4000)] + [(5000 + k, "hot copy") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    load = check(sharding.shard(docs, 8, bundles=64).collect(), rows)
    assert max(load.values()) < 1.2 * sum(load.values()) / 8


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op7_sharding"](spark, sf_dir).collect()
    check(rows, [tuple(r) for r in docs], slack=max(len((r["text"] or "").encode()) for r in docs))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
