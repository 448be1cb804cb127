"""Temporal list join against a plain evaluation."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from placeloom.llm import urlfilter
from placeloom.llm.queries import ORACLE_SQL, QUERIES

ENTRY = "list string, effect string, kind string, pattern string, action string, at long"


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(ORACLE_SQL["op1_url_filters"])
    got = QUERIES["op1_url_filters"](spark, sf_dir)
    cols = want.columns
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain(url, t, entries):
    import re

    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)", url or "")
    host = m[1].lower().rstrip(".") if m else ""
    if not host:
        return "invalid", 0, 0
    path = "/".join([host, *(s for s in m[2].lower().split("/") if s)])
    active = {"block": 0, "allow": 0}
    for key in {tuple(e[:4]) for e in entries if None not in e}:
        name, effect, kind, pattern = key
        changes = sorted((e[5], e[4] == "remove") for e in entries if tuple(e[:4]) == key and None not in e)
        past = [removed for at, removed in changes if t is not None and at <= t]
        pattern = pattern.lower().rstrip("/")
        hit = {"host": host == pattern, "domain": host == pattern or host.endswith("." + pattern), "prefix": path == pattern or path.startswith(pattern + "/")}[kind]
        if past and not past[-1] and hit:
            active[effect] += 1
    return ("allow" if active["allow"] else "block" if active["block"] else "none"), active["block"], active["allow"]


def test_random_lists(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "notb.org", "A.com:80", "u@b.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p", "/p/q?x=1", "/P/Q/r#f", "/pq")] + [None, "", "nothing", "/rel", "http://", "//b.org./p"]
    captures = [(k, rng.choice(urls), rng.choice([None, *range(0, 50)])) for k in range(400)]
    patterns = [("domain", "a.com"), ("host", "x.a.com"), ("host", "b.org"), ("prefix", "b.org/p"), ("prefix", "a.com/p/q/"), ("domain", "org"), ("prefix", "a.com")]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["block", "allow"]), *rng.choice(patterns), rng.choice(["add", "remove"]), rng.randint(0, 50)) for _ in range(60)]
    entries += [entries[0], (None, "block", "host", "b.org", "add", 1), ("l1", "block", "host", None, "add", 1), ("l1", "block", "host", "b.org", "add", None)]
    df = spark.createDataFrame(captures, "id long, url string, fetched long")
    got = urlfilter.evaluate(df, spark.createDataFrame(entries, ENTRY)).collect()
    assert len(got) == len(captures)
    times = {c[0]: c for c in captures}
    for r in got:
        assert (r["verdict"], r["n_block"], r["n_allow"]) == plain(times[r["id"]][1], times[r["id"]][2], entries), times[r["id"]]


def test_intervals(spark):
    e = spark.createDataFrame([("l", "block", "host", "H/", "add", 1), ("l", "block", "host", "h", "remove", 5), ("l", "block", "host", "h", "add", 5), ("l", "block", "host", "h", "add", 9)], ENTRY)
    assert sorted((r["since"], r["until"]) for r in urlfilter.intervals(e).collect()) == [(1, 5), (9, None)]


def test_gaps_and_clashing_names(spark):
    rows = [("http://a.com/x", 5, "mine", 1, 2)] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, fetched long, host string, verdict int, since int")
    entries = spark.createDataFrame([("l", "block", "domain", "a.com", "add", 3)], ENTRY)
    got = urlfilter.evaluate(df, entries)
    assert got.columns == ["url", "fetched", "host", "verdict", "since", "_host", "_verdict", "n_block", "n_allow", "_since"]
    assert sorted(r["_verdict"] for r in got.collect()) == ["block", "block", "invalid"]
    assert {r["_verdict"] for r in urlfilter.evaluate(df, entries.where("false")).collect()} == {"none", "invalid"}
    assert urlfilter.evaluate(df.where("false"), entries).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op1_url_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("url", ["http://A.B.com.:8080/x", "https://u:p@a.b.com/x?y"])
def test_hosts(spark, url):
    assert spark.range(1).select(urlfilter.host_of(F.lit(url))).first()[0] == "a.b.com"
