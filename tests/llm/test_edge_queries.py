"""Every query over tables of odd rows and over empty ones: nulls in any column, repeated rows, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from placeloom.llm import common, mixing, packing, sharding, urlfilter
from placeloom.llm.queries import QUERIES

PAGES = [
    (1, "http://a.example/x", "<article><p>one two three</p></article>"), (2, None, None), (None, "http://b.example", "<p>a b"), (None, None, None), (3, "not a url", ""), (4, "http://c.example/" + "y" * 3000, "<p>" + "long " * 50_000), (5, "http://a.example/x", "<article><p>one two three</p></article>"),
    (5, "http://a.example/x", "<article><p>one two three</p></article>"), (6, "http://é.example/ü", "<p>é 漢字 😀</p>"),
]
VECTORS = [(0, [0.1, 0.2, 0.3]), (1, [0.2, 0.1, 0.3]), (50, None), (50, []), (None, [0.5]), (1, [0.2, 0.1, 0.3]), (2, [float("nan"), 1.0, 0.0])]


@pytest.fixture(scope="module")
def folder(spark, clashing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    clashing.repartition(3).write.parquet(f"{path}/documents.parquet")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    pages.select("*", *[F.lit(None).cast("string").alias(c) for c in ("host", "verdict", "text", "payload", "n_chars", "since", "n")]).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("id", F.lit(7)).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    table = "pages" if name in ("op1_url_filters", "op3_html_extraction", "op4_warc") else "documents"
    if name == "op9_packing":
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        assert sum(r["start"] == 0 for r in rows) == len(docs)
    elif name != "op5_media_columns":
        assert len(rows) == spark.read.parquet(f"{folder}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_warc_query_against_plain_rules(spark, folder):
    """Digests, types and references of all pages, each counted."""
    by: dict = {}
    for page, _, html in PAGES:
        by.setdefault((html or "").encode(), []).append(page)
    want = []
    for body, ids in by.items():
        known = [i for i in ids if i is not None]
        last = max(known) if known and len(ids) > 1 else None
        for i in ids:
            refers = last if last is not None and i != last else None
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(tuple, QUERIES["op4_warc"](spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_sharding_query_keeps_rows(spark, folder):
    docs = [((r["text"] or "").encode(), r["doc_id"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op7_sharding"](spark, folder).collect()
    assert sorted(((zlib.crc32(b), i, len(b) + 1) for b, i in docs), key=repr) == sorted(((r["text_crc32"], r["doc_id"], r["size"]) for r in got), key=repr)


def test_equal_rows_are_numbered_apart(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("k").alias("key"), F.lit(2).cast("long").alias("size"), F.lit(3).cast("long").alias("text_crc32"), F.lit(0).alias("shard"))
    got = sharding.numbered(rows, "doc_id", crowded=100).collect()
    assert sorted(r["slot"] for r in got) == list(range(5000))


def test_ranks_of_many_sources(spark):
    names = [f"s{k:05d}" for k in range(3000)] + [None]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in reversed(names)], "source string").repartition(7), "source").collect()
    assert [r["source"] for r in sorted(got, key=lambda r: r["rank"])] == names and sorted(r["rank"] for r in got) == list(range(3001))


def test_a_hot_listed_host(spark):
    captures = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://hot.example/p"), F.col("id"))).otherwise("http://cold.example/").alias("url"), F.col("id").alias("fetched"))
    entries = spark.createDataFrame([("l", "block", "host", "hot.example", "add", 5000), ("l", "block", "host", "hot.example", "remove", 10_000)], "list string, effect string, kind string, pattern string, action string, at long")
    got = urlfilter.evaluate(captures, entries).groupBy("verdict").count().collect()
    blocked = sum(k % 3 == 0 for k in range(5000, 10_000))
    assert {r["verdict"]: r["count"] for r in got} == {"block": blocked, "none": 20_000 - blocked}


def test_buckets_hold_equal_lengths(spark, folder, tmp_path):
    from placeloom.llm.queries import tokenizer_path

    packed = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path(), 64)
    packing.write_buckets(packed, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert back.count() == packed.count() and back.where("length <> cast(pow(2, bucket) as long) or octet_length(ids) <> 4 * length").count() == 0


def test_scratch_is_cleared(spark, tmp_path):
    for name in ("placeloom-old-1", "placeloom-old-2", "others"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    assert common.clear_scratch(spark, 1.0, str(tmp_path)) == 0
    assert common.clear_scratch(spark, -1.0, str(tmp_path)) == 2 and [p.name for p in tmp_path.iterdir()] == ["others"]
