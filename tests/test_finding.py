"""Full-text search and deep pages against plain versions."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from placeloom.functions.text import STOP_WORDS
from placeloom.operators import paging, search

#: Words with the stems that Porter gives them.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "hopping": "hop", "falling": "fall", "fizzed": "fizz", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "sensitiviti": "sensit", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "replacement": "replac", "adjustment": "adjust",
    "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "restaurants": "restaur", "as": "as", "ünïts": "ünïts", "covid19": "covid19",
}

DOCS = {1: "The cats of Rome were running home", 2: "Running cats, running dogs!", 3: "A cat ran. ROME of cats", 4: None, 5: "", 6: "cats in the streets of Rome: Rome's cats", 7: "dogs run in Rome"}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", search.stem(F.col("w")).alias("s")).collect()
    assert all(search.stem_word(r["w"]) == r["s"] for r in rows)
    assert {r["w"]: r["s"] for r in rows} == STEMS


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "postings")
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string")
    search.write_postings(search.spread(docs, "id", "text"), path, buckets=8, salts=2)
    return path



@pytest.mark.parametrize(
    ("asked", "found"),
    [
        (search.Query(all_of=["cats"]), {1, 2, 3, 6}), (search.Query(all_of=["cat running"]), {1, 2}), (search.Query(any_of=["dog", "home"]), {1, 2, 7}), (search.Query(all_of=["Rome"], none_of=["street run"]), {3}), (search.Query(all_of=["rome"], none_of=["dogs"], any_of=["cats", "nothing"]), {1, 3, 6}),
        (search.Query(phrases=["cats of Rome"]), {1, 3}), (search.Query(phrases=["street of the rome"]), {6}), (search.Query(phrases=["street rome"]), set()), (search.Query(phrases=["streets of rome"]), {6}), (search.Query(phrases=["rome s cat"]), {6}), (search.Query(phrases=["running cats"], all_of=["the dogs"]), {2}), (search.Query(all_of=["unheard"]), set()),
    ],
)
def test_queries(spark, index, asked, found):
    got = search.search(spark, index, asked, len(DOCS), buckets=8).collect()
    assert {r["doc"] for r in got} == found and len(got) == len(found)


def test_ranks_and_nothing_to_look_for(spark, index):
    import math

    got = {r["doc"]: r["rank"] for r in search.search(spark, index, search.Query(any_of=["running", "dogs"]), 7, buckets=8).collect()}
    run, dog = math.log1p(7 / 3), math.log1p(7 / 2)
    assert got == pytest.approx({1: run / 2, 2: run * 2 / 3 + dog / 2, 7: run / 2 + dog / 2})
    with pytest.raises(ValueError):
        search.search(spark, index, search.Query(all_of=["the of"], none_of=["cats"]), 7)
    assert set(STOP_WORDS) >= {"the", "of"}


def test_a_search_reads_its_terms_only(spark, index):
    plan = search.search(spark, index, search.Query(all_of=["cats"]), 7, buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"PushedFilters: \[[^\]]*(?:EqualTo|In)\(term", plan)


def _rows(rng, n):
    pick = lambda *x: rng.choice([None, *x])
    return [(k, pick("a", "b", "long common beginning of x", "long common beginning of y", "é", ""), pick(1.5, -2.0, 0.0, float("nan"), float("inf"), 1e300), pick(True, False)) for k in range(n)]


@pytest.mark.parametrize("order", [[("s", True)], [("s", False), ("x", True)], [("x", False)], [("b", True), ("x", True), ("s", False)], []])
def test_pages_at_any_depth(spark, order):
    """Pages, one after another, are the sorted rows; ties and nulls included."""
    rng = random.Random(2)
    df = spark.createDataFrame(_rows(rng, 400), "k long, s string, x double, b boolean").repartition(3).cache()
    order = [*order, ("k", False)]
    want = [r["k"] for r in df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order]).collect()]
    for number in (1, 2, 7, 13, 40, 41, 1000):
        got = paging.deep_page(df, order, paging.Page(10, number), most=5, buckets=4)
        assert [r["k"] for r in got.collect()] == want[(number - 1) * 10 : number * 10], number
    assert paging.deep_page(df.where("false"), order, paging.Page(10, 3)).count() == 0


def test_a_deep_page_sorts_few_rows(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"))
    page = paging.deep_page(df, [("k", True)], paging.Page(10, 9_000), most=2_000)
    assert [r["k"] for r in page.collect()] == [r["k"] for r in df.orderBy("k").offset(89_990).limit(10).collect()]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_blocks_and_repeated_ids(spark, monkeypatch):
    import re

    rows = [(1, "cat dog cat"), (1, "dog cats the"), (2, None), (None, "Dogs dog"), (3, "the of"), (4, " ".join(f"word{k % 50}x" for k in range(500))), (5, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    want: dict = {}
    for doc, text in rows:
        for k, w in enumerate(x for x in re.split(r"[\W_]+", (text or "").lower()) if x):
            if w not in search.STOP_WORDS:
                want.setdefault((search.stem_word(w), doc), set()).add(k)
    got = {(r["term"], r["doc"]): r["positions"] for r in search.postings(docs, "id", "text").collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    import pyarrow as pa

    monkeypatch.setattr(search, "BLOCK", 3)
    words = [re.split(r"\W+", t) if t else [] for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array(words, pa.list_(pa.string()))], ["doc", "words"])
    cut = [r for b in search._told(iter([batch.slice(0, 0), batch, batch.slice(3)])) for r in b.to_pylist()]
    whole = [r for b in (search._gathered(batch.column(0), batch.column(1)), search._gathered(batch.slice(3).column(0), pa.array(words[3:], pa.list_(pa.string())))) for r in b.to_pylist()]
    of = lambda rs: sorted(((r["term"], r["doc"], r["positions"]) for r in rs), key=repr)
    assert of(cut) == of(whole)


def test_deep_page_reads_its_rows_a_few_times(spark, tmp_path):
    """What is equal throughout takes no turn, and what is left of the rows is stored, so files are read a few times only."""
    rows = spark.range(50_000).select((F.col("id") % 2).cast("string").alias("flag"), F.lit("the same text of more than eighteen letters").alias("same"), (F.col("id") * 7919 % 50_000).cast("double").alias("price"), "id")
    rows.write.parquet(f"{tmp_path}/rows")
    df, order = spark.read.parquet(f"{tmp_path}/rows"), [("flag", False), ("same", True), ("price", True), ("id", True)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "")
    got = [r["id"] for r in paging.deep_page(df, order, paging.Page(10, 4000), most=20, buckets=16).collect()]
    assert len(jobs.getJobIdsForGroup("deep")) < 20
    want = sorted((r for r in df.collect()), key=lambda r: (-int(r["flag"]), r["price"], r["id"]))[39_990:40_000]
    assert got == [r["id"] for r in want]


def test_postings_are_made_where_a_document_is_read(spark, tmp_path, monkeypatch):
    """Unlike ids shuffle no postings; rows of one id, and of none, still are one document, also in a search and if many ids repeat."""
    once = spark.createDataFrame([(1, "cat dog cat"), (None, "Dogs dog"), (3, None)], "id int, text string")
    assert "Exchange" not in search.postings(once, "id", "text")._jdf.queryExecution().executedPlan().toString()
    rows = [*[(r["id"], r["text"]) for r in once.collect()], (1, "bird cat dogs"), (None, "birds"), (4, "bird dog")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    want = [("bird", None, [0]), ("bird", 1, [0]), ("bird", 4, [0]), ("cat", 1, [0, 1, 2]), ("dog", None, [0, 1]), ("dog", 1, [1, 2]), ("dog", 4, [1])]
    for most in (50_000, 1):
        monkeypatch.setattr(search, "BROADCAST_ROWS", most)
        got = [(r["term"], r["doc"], r["positions"]) for r in search.postings(docs, "id", "text").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    search.write_postings(search.spread(docs, "id", "text"), f"{tmp_path}/index", buckets=8)
    found = search.search(spark, f"{tmp_path}/index", search.Query(all_of=["bird", "cat"]), 4, buckets=8).collect()
    assert [r["doc"] for r in found] == [1] and found[0]["rank"] == pytest.approx(0.5 * math.log1p(4 / 3) + 0.75 * math.log1p(4))
    dogs = search.search(spark, f"{tmp_path}/index", search.Query(phrases=["cat dogs"]), 4, buckets=8).collect()
    assert [r["doc"] for r in dogs] == [1]
