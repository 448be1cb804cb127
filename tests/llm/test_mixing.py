"""The mix: targets, closeness, nested thresholds, and the SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

from placeloom.llm import mixing
from placeloom.llm.queries import ORACLE_SQL, QUERIES


def fill(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over or len(over) == len(free):
            return {s: min(most * sizes[s], w[s] * level) for s in order}
        capped |= over


def test_edges(edges):
    rows = edges.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = fill(sizes)
    got = mixing.plan_mix(edges).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    largest: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] * 2  # rows repeated with their id are taken together
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_sql_and_reruns(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    a = sorted(tuple(r) for r in QUERIES["op6_mixing"](spark, sf_dir).collect())
    assert a == sorted(con.sql(ORACLE_SQL["op6_mixing"]).fetchall())
    assert a == sorted(tuple(r) for r in QUERIES["op6_mixing"](spark, sf_dir).collect())


def test_a_larger_budget_takes_a_superset(spark, edges):
    few = {(r["doc_id"], r["copies"]) for r in mixing.plan_mix(edges, (1, 2, 3)).where("source = 'src2'").collect()}
    more = dict(r for r in ((r["doc_id"], r["copies"]) for r in mixing.plan_mix(edges, (1, 1, 1, 1, 9)).where("source = 'src2'").collect()))
    assert few and (all(more[d] >= c for d, c in few) or all(more[d] <= c for d, c in few))


def test_rows_are_repeated(clashing, nothing):
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    plan = mixing.plan_mix(clashing).where("size > 0")
    assert mixed.count() == plan.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(nothing).count() == mixing.plan_mix(nothing).count() == 0
