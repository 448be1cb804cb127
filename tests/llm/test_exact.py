"""Exact dedup and its filters against plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import exact
from placeloom.llm.queries import QUERIES


def plain(rows) -> list[tuple]:
    """Per row: id, keep_id, group_size, kept, SHA-256; of equal rows the first stays."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out, done = [], set()
    for i, text in rows:
        t = text or ""
        kept = i == keep[t] and t not in done
        if kept:
            done.add(t)
        out.append((i, keep[t], len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def sparks(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=60), min_size=1, max_size=4), st.sampled_from([9, 10, 16, 40]))
def test_filters_merge_without_loss(parts, bits):
    made = []
    for part in parts:
        prints, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        made.append(exact.QuotientFilter.of(prints, counts, bits))
    prints, counts = exact.merged(made, bits).counts()
    assert dict(zip(prints.tolist(), counts.tolist())) == Counter(x for p in parts for x in p)
    assert (np.diff(prints.astype(np.int64)) > 0).all()


def test_large_counts_and_geometries():
    """Counts of many digits, remainders of no bits and of 63."""
    for bits, prints, counts in [(1, [0, 1], [1, 10**6]), (3, [0, 3, 7], [5, 1, 70_000]), (64, [0, 5, 2**64 - 1], [2**40, 1, 3]), (8, list(range(256)), list(range(1, 257)))]:
        f = exact.QuotientFilter.of(np.array(prints, np.uint64), np.array(counts), bits)
        again = exact.QuotientFilter.from_row(dict(zip([c.split()[0] for c in exact.FILTER.split(", ")], f.row(3))))
        got = again.counts()
        assert got[0].tolist() == prints and got[1].tolist() == counts
        assert exact.merged([f, f], bits).counts()[1].tolist() == [2 * c for c in counts]


@pytest.mark.parametrize("bits", [64, 20, 9, 6])
def test_rows_against_plain(edges, bits):
    """Few bits make unlike texts meet; their bytes tell them apart."""
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert sparks(exact.group_equal(edges, bits=bits)) == plain(rows)


def test_query_against_plain(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sparks(QUERIES["op11_exact_dedup"](spark, sf_dir)) == plain(rows)


def test_clashing_names_and_no_rows(clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    assert sparks(exact.group_equal(clashing)) == plain(rows)
    assert exact.group_equal(nothing).count() == 0
    assert sparks(exact.group_equal(clashing.withColumnRenamed("doc_id", "key2"), "key2")) == plain(rows)


def test_hot_text_and_small_gathers(spark, monkeypatch):
    """A third of all rows are one text; tasks write filters more than once."""
    monkeypatch.setattr(exact, "GATHERED", 100)
    rows = [(k, "hot" if k % 3 == 0 else f"text {k // 2}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sparks(exact.group_equal(docs)) == plain(rows)


def test_filters_hold_each_count_once(spark):
    from pyspark.sql import functions as F

    prints = spark.range(20_000).select(F.pmod(F.xxhash64(F.col("id") % 7000), F.lit(1 << 30)).alias("fp")).repartition(6)
    whole = exact.merge(exact.filters(prints, "fp", 30, 8), 30, 8)
    assert whole.count() == whole.select("segment").distinct().count() > 200
    want = prints.groupBy("fp").count()
    assert sparks(exact.counted(whole)) == sparks(want)
