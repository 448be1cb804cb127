"""Containment in JSON documents against a comparison of all pairs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import documents

#: Document, pattern, whether it is held.
CASES = [
    ('{"a": 1, "b": [1, 2]}', '{"b": [2]}', True), ('{"a": 1.0}', '{"a": 1}', True), ('{"a": 100}', '{"a": 1e2}', True), ('{"a": -0}', '{"a": 0.0}', True), ('{"a": 1}', '{"a": true}', False), ('{"a": 1}', '{"a": "1"}', False), ('{"a": null}', '{"a": null}', True), ('{}', '{"a": null}', False),
    ('{"a": {"b": {"c": [3]}}}', '{"a": {"b": {}}}', True), ('{"a": {"b": 1}}', '{"b": 1}', False), ('[{"a": 1}, {"b": 2}]', '[{"b": 2}]', True), ('[{"a": 1}, {"b": 2}]', '[{"a": 1, "b": 2}]', False), ('[{"a": 1}]', '{"a": 1}', False), ('[1, [2, 3]]', '[[3]]', True), ('[1, [2, 3]]', '[3]', False), ('[1, 2]', '[2, 2, 1]', True),
    ('["x", "y"]', '"y"', True), ('[["y"]]', '"y"', False), ('{"t": ["y"]}', '{"t": "y"}', False), ('"y"', '["y"]', False), ('{"a": 1, "a": 2}', '{"a": 1}', False), ('{"a": 1, "a": 2}', '{"a": 2}', True), ('[]', '[]', True), ('{}', '[]', False), ('{"a": "é\\u00e9"}', '{"a": "éé"}', True), ('{"a": 12345678901234567890123456789012345}', '{"a": 12345678901234567890123456789012346}', False),
]


@pytest.mark.parametrize(("held", "asked", "is_held"), CASES)
def test_cases(held, asked, is_held):
    a, b = documents.parsed(held), documents.parsed(asked)
    assert documents.holds(a, b) == is_held
    assert not is_held or documents.entries(b) <= documents.entries(a)


@pytest.mark.parametrize("text", [None, "", "{", "nan", "[NaN]", "[1e99999999999999999999]", "[" * 500 + "]" * 500, "[" * 100_000 + "]" * 100_000])
def test_no_documents(text):
    assert documents.entries(documents.parsed(text)) == set()


def _some(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice("abc"): _some(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.7:
        return [_some(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, 1.0, 2, True, False, None, "1", "x", ""])


def _plainly(held, asked, top=True):
    """The rule word by word."""
    if isinstance(asked, dict) or isinstance(held, dict):
        return isinstance(asked, dict) and isinstance(held, dict) and all(k in held and _plainly(held[k], asked[k], False) for k in asked)
    if isinstance(asked, list):
        return isinstance(held, list) and all(any(_plainly(h, a, False) for h in held) for a in asked)
    if isinstance(held, list):
        return top and any(_plainly(h, asked, False) for h in held)
    return isinstance(held, bool) == isinstance(asked, bool) and held == asked


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    docs = [(k, json.dumps(_some(rng, 3))) for k in range(300)] + [(None, '{"a": 1}'), (300, None), (301, "no json"), (302, ""), (7, '{"b": {"c": "second row"}}'), (303, '{"a": ["' + "long " * 200_000 + '"]}')]
    df = spark.createDataFrame(docs, "id long, entry string").withColumn("doc", F.lit("clashes")).repartition(3)
    path = str(tmp_path_factory.mktemp("documents") / "index")
    documents.write_index(df, "id", "entry", path, buckets=8, salts=2)
    return docs, df, path


def _want(docs, asked):
    ok = [(k, json.loads(t)) for k, t in docs if t and t != "no json"]
    return {k for k, v in ok if _plainly(v, json.loads(asked))}


@pytest.mark.parametrize("asked", ["{}", "[]", "1", "null", '"x"', '{"a": {}}', '{"a": 1}', '[{"a": []}]', '{"a": {"b": 1}}', '[1, true]', '{"b": {"c": "second row"}}', '{"a": "nowhere"}'])
def test_one_pattern(spark, stored, asked):
    docs, df, path = stored
    got = [r["doc"] for r in documents.holding(spark, path, df, "id", "entry", asked, buckets=8).collect()]
    assert len(got) == len(set(got)) and set(got) == _want(docs, asked)


def test_a_table_of_patterns(spark, stored):
    docs, df, path = stored
    rng = random.Random(5)
    asked = [(k, json.dumps(_some(rng, 2))) for k in range(60)] + [(60, None), (61, "{"), (None, '{"a": 1}')]
    table = spark.createDataFrame([*asked, asked[0]], "doc long, text string").withColumn("entry", F.lit(1))
    got = documents.matches(spark, path, df, "id", "entry", table, "doc", "text", buckets=8).collect()
    want = {(p, d) for p, t in asked if t and t != "{" for d in _want(docs, t)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 500
    assert documents.matches(spark, path, df, "id", "entry", table.where("false"), "doc", "text", buckets=8).count() == 0


def test_empty_tables_and_broken_patterns(spark, stored, tmp_path):
    _, df, path = stored
    with pytest.raises(ValueError):
        documents.holding(spark, path, df, "id", "entry", "{", buckets=8)
    documents.write_index(df.where("false"), "id", "entry", str(tmp_path / "none"))
    assert documents.holding(spark, str(tmp_path / "none"), df.where("false"), "id", "entry", "{}").count() == 0


def test_a_rare_pattern_reads_few_entries(spark, stored):
    _, df, path = stored
    plan = documents.holding(spark, path, df, "id", "entry", '{"b": {"c": "second row"}}', buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(entry" in plan


def test_what_all_documents_have_is_a_row_a_block(spark, tmp_path):
    """Entries of all documents don't make a posting each, and rows of one id still count as one document."""
    docs = spark.range(4000).repartition(2).select("id", F.concat(F.lit('{"all": {"same": [1, "x"]}, "own": '), F.col("id").cast("string"), F.lit("}")).alias("body"))
    docs = docs.unionByName(docs.where("id < 10"))
    documents.write_index(docs, "id", "body", str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/postings").count()
    assert 4000 < rows < 4000 + 10 * 40  # one entry of its own each
    got = [r["doc"] for r in documents.holding(spark, str(tmp_path), docs, "id", "body", '{"all": {"same": ["x"]}}').collect()]
    assert sorted(got) == list(range(4000))
    few = spark.createDataFrame([(0, '{"own": 7}'), (1, '{"own": 4000}')], "id long, body string")
    assert [tuple(r) for r in documents.matches(spark, str(tmp_path), docs, "id", "body", few, "id", "body").collect()] == [(0, 7)]
