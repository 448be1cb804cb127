"""Answers by a schema: a table of cases, nested types, SQL, and what the schema must be."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from placeloom.operators import extraction

GOOD = {"name": "Blue Door", "city": "Lyon", "neighborhood": "", "address": "", "category": "Bar", "description": "é 𝄞", "creator_handle": "@a", "confidence": 0.5}


def _answer(*places, **more):
    return json.dumps({"places": list(places), **more})


def _without(key):
    return {k: v for k, v in GOOD.items() if k != key}


CASES = [
    (_answer(GOOD), [(0, "Blue Door", "Lyon", 0.5, [])]),
    (_answer(), []),
    (None, []),
    ("", []),
    (" \n", []),
    ('{"places": [', [(None, None, None, None, [": not JSON"])]),
    ('{"places": NaN}', [(None, None, None, None, [": not JSON"])]),
    ("[" * 100000, [(None, None, None, None, [": not JSON"])]),
    ("[]", [(None, None, None, None, [": not a object"])]),
    ("{}", [(None, None, None, None, ["/places: missing"])]),
    ('{"places": null}', [(None, None, None, None, ["/places: null"])]),
    ('{"places": {}}', [(None, None, None, None, ["/places: not a array"])]),
    (_answer(GOOD, mood=1), [(None, None, None, None, ["/mood: not allowed"]), (0, "Blue Door", "Lyon", 0.5, [])]),
    (_answer(GOOD | {"name": None}), [(0, None, "Lyon", 0.5, [])]),
    (_answer(GOOD | {"city": None}), [(0, "Blue Door", None, 0.5, ["/places/0/city: null"])]),
    (_answer(_without("city"), GOOD), [(0, "Blue Door", None, 0.5, ["/places/0/city: missing"]), (1, "Blue Door", "Lyon", 0.5, [])]),
    (_answer(GOOD | {"confidence": "0.5"}), [(0, "Blue Door", "Lyon", None, ["/places/0/confidence: not a number"])]),
    (_answer(GOOD | {"confidence": True}), [(0, "Blue Door", "Lyon", None, ["/places/0/confidence: not a number"])]),
    (_answer(GOOD | {"confidence": 1}), [(0, "Blue Door", "Lyon", 1.0, [])]),
    (_answer(GOOD).replace("0.5", "1e999"), [(0, "Blue Door", "Lyon", None, ["/places/0/confidence: out of range"])]),
    (_answer(GOOD).replace("0.5", "1" + "0" * 400), [(0, "Blue Door", "Lyon", None, ["/places/0/confidence: out of range"])]),
    (_answer(GOOD | {"z": 1, "a/b~": 2}), [(0, "Blue Door", "Lyon", 0.5, ["/places/0/a~1b~0: not allowed", "/places/0/z: not allowed"])]),
    (_answer(GOOD | {"\ud800": 1}), [(0, "Blue Door", "Lyon", 0.5, ["/places/0/\\ud800: not allowed"])]),
    (_answer(GOOD | {"city": "\ud800"}), [(0, "Blue Door", None, 0.5, ["/places/0/city: not Unicode"])]),
    (_answer(GOOD | {"city": 3, "name": []}), [(0, None, None, 0.5, ["/places/0/name: not a string", "/places/0/city: not a string"])]),
    (_answer(GOOD, 7, None), [(0, "Blue Door", "Lyon", 0.5, []), (1, None, None, None, ["/places/1: not a object"]), (2, None, None, None, ["/places/2: null"])]),
    (_answer(GOOD).replace('"city": "Lyon"', '"city": "Rome", "city": "Nice"'), [(0, "Blue Door", "Nice", 0.5, [])]),
    (_answer(*[GOOD] * 3000), [(k, "Blue Door", "Lyon", 0.5, []) for k in range(3000)]),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(k, a) for k, (a, _) in enumerate(CASES)], "id int, answer string")


def test_cases(posts):
    got = {}
    for r in extraction.extracted(posts).orderBy("id", F.col("item").asc_nulls_first()).collect():
        got.setdefault(r["id"], []).append((r["item"], r["name"], r["city"], r["confidence"], r["violations"]))
    for k, (answer, want) in enumerate(CASES):
        assert got.get(k, []) == want, answer and answer[:200]


def test_posts_without_rows_are_kept_if_asked(posts):
    kept = extraction.extracted(posts, keep_empty=True).where("item IS NULL AND size(violations) = 0").select("id").collect()
    assert sorted(r["id"] for r in kept) == [k for k, (_, want) in enumerate(CASES) if not want]


def test_strict_refuses_whole_answers(posts):
    got = extraction.strict(extraction.extracted(posts), "id")
    assert "violations" not in got.columns
    want = sorted((k, row[0]) for k, (_, rows) in enumerate(CASES) if not any(r[-1] for r in rows) for row in rows)
    assert sorted((r["id"], r["item"]) for r in got.collect()) == want


def test_columns_come_from_the_schema(spark):
    element = {"type": "object", "properties": {
        "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": ["string", "null"]}},
        "at": {"type": ["object", "null"], "properties": {"x": {"type": "number"}, "ok": {"type": "boolean"}}, "required": ["x"]},
        "kind": {"type": "string", "enum": ["a", "b"]},
    }, "required": ["n"]}
    schema = {"type": "object", "properties": {"rows": {"type": "array", "items": element}, "note": {"type": "string"}}, "required": ["rows"]}
    answer = json.dumps({"rows": [
        {"n": 2.0, "tags": ["x", None], "at": {"x": 1, "ok": True}, "kind": "a", "free": 1},
        {"n": 1.5, "tags": ["x", 3], "at": {"ok": 0}, "kind": "c"}, {"n": 1 << 63}, {"n": -(1 << 63), "at": None},
    ]})
    extraction.register(spark)
    spark.createDataFrame([(answer,)], "answer string").createOrReplaceTempView("answers")
    got = spark.sql(f"SELECT r.* FROM answers, LATERAL extract_items(answer, '{json.dumps(schema)}') r ORDER BY item")
    assert got.schema.simpleString() == "struct<item:int,n:bigint,tags:array<string>,at:struct<x:double,ok:boolean>,kind:string,violations:array<string>>"
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == (0, 2, ["x", None], (1.0, True), "a", [])
    assert rows[1] == (1, None, ["x", None], (None, None), None, ["/rows/1/n: not a integer", "/rows/1/tags/1: not a string", "/rows/1/at/x: missing", "/rows/1/at/ok: not a boolean", "/rows/1/kind: not one of the values"])
    assert rows[2] == (2, None, None, None, None, ["/rows/2/n: out of range"])
    assert rows[3] == (3, -(1 << 63), None, None, None, [])


def test_empty_table_and_repeated_rows(spark, posts):
    assert extraction.extracted(posts.where("false")).count() == 0
    twice = extraction.extracted(posts.where("id = 0").union(posts.where("id = 0")))
    assert [r["name"] for r in twice.collect()] == ["Blue Door"] * 2


def test_what_the_schema_must_be(spark, posts):
    with pytest.raises(ValueError, match="named"):
        extraction.extracted(posts.withColumnRenamed("id", "city"))
    for bad in ({"type": "object", "properties": {}}, {"type": ["string", "number"]}, {"type": "array", "items": {"type": "object", "properties": {}}}):
        with pytest.raises(ValueError):
            extraction.extracted(posts, schema=bad)
    extraction.register(spark)
    posts.createOrReplaceTempView("posts_of_cases")
    with pytest.raises(AnalysisException, match="constant"):
        spark.sql("SELECT * FROM posts_of_cases, LATERAL extract_items(answer, answer)").collect()


def test_strict_answers_are_read_once(spark):
    """A fault refuses its answer where it is read, with the rows that ``strict`` leaves of answers of different keys."""
    import json

    good = {k: "x" for k in ("name", "city", "neighborhood", "address", "category", "description", "creator_handle")} | {"confidence": 1}
    answers = [{"places": [good, good]}, {"places": [good, good | {"city": 1}]}, {"places": [good], "mood": 1}, {"places": []}]
    posts = spark.createDataFrame([*enumerate(map(json.dumps, answers)), (4, "{"), (5, None)], "id int, answer string")
    got = extraction.extracted(posts, refuse=True)
    assert sorted((r["id"], r["item"]) for r in got.collect()) == [(0, 0), (0, 1)]
    assert sorted(got.drop("violations").collect()) == sorted(extraction.strict(extraction.extracted(posts), "id").collect())


def test_a_schemas_keys_are_told_once(monkeypatch):
    """Steps of paths aren't made anew for each value of each answer; faults are named as before."""
    place = {k: "é" if k == "category" else "x" for k in extraction.PLACES["properties"]["places"]["items"]["properties"]} | {"confidence": 0.5}
    told = extraction.Extract(extraction.Shape(schema=extraction.data_type(extraction.PLACES), asked=extraction.PLACES))
    list(told.eval(json.dumps({"places": [place]}), ""))
    made = []
    monkeypatch.setattr(extraction, "_shown", lambda key: made.append(key) or key)
    rows = list(told.eval(json.dumps({"places": [place, place | {"confidence": "1"}, place | {"city": "\ud800"}]}), ""))
    assert not made and [r[-1] for r in rows] == [[], ["/places/1/confidence: not a number"], ["/places/2/city: not Unicode"]]
    assert list(told.eval(json.dumps({"places": [place | {"mood": 1}]}), ""))[0][-1] == ["/places/0/mood: not allowed"] and made == ["mood"]
