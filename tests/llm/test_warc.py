"""Archives: round trips, revisits, pushed-down filters, split files, foreign archives."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from placeloom.llm import warc

PREFIX = "tag:test,2025:page/"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "same", 0), (2, "http://a/2", "same", 0), (3, None, None, 0), (4, "http://b/4", "", 0), (5, "http://b/5 x\n", "WARC/1.1\r\n\r\n\x1f\x8b", 0), (6, "http://c/6", "é" * 50_000, 0), (None, "http://c/7", "same", 0), (8, "http://c/8", "own", 0), (8, "http://c/8", "own", 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(spark, pages):
    rows = warc.archive(pages, PREFIX).collect()
    got = {r["record_id"].removeprefix(PREFIX): r for r in rows}
    assert len(rows) == 9
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    for r in pages.collect():
        page, body = str(r["page_id"] or ""), r["html"] or ""
        row = got[page]
        assert row["payload_digest"] == sha(body) and row["payload_length"] == len(body.encode())
        if row["record_type"] == "response":
            assert bytes(row["payload"]).decode() == body and row["refers_to"] is None
        else:
            assert row["payload"] is None
    assert {p: (g["record_type"], g["refers_to"]) for p, g in got.items()} == {
        "1": ("revisit", PREFIX + "2"), "2": ("response", None), "": ("revisit", PREFIX + "2"), "3": ("revisit", PREFIX + "4"), "4": ("response", None), "5": ("response", None), "6": ("response", None), "8": ("response", None)
    }
    assert got["3"]["target_uri"] is None and got["5"]["target_uri"] == "http://b/5%20x%0A"
    few = warc.archive(pages, PREFIX, least_bytes=4)
    assert {r["record_id"] for r in few.where("record_type = 'revisit'").collect()} == {PREFIX + "1", PREFIX}
    assert warc.archive(pages.where("false"), PREFIX).count() == 0  # an empty folder reads as no records


@pytest.fixture(scope="module")
def folder(spark, pages, tmp_path_factory):
    warc.register(spark)
    path = str(tmp_path_factory.mktemp("warc") / "archives")
    many = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.concat(F.lit("body "), F.col("id"), F.repeat(F.lit(" word"), 50)).alias("html"))
    warc.records(many, PREFIX).coalesce(2).write.format("warc").mode("append").save(path)
    return path


@pytest.mark.parametrize("split", [700, 5_000, 10**9])
def test_split_files_lose_nothing(spark, folder, split):
    df = spark.read.format("warc").option("split", split).option("verify", "true").load(folder)
    rows = df.select("record_id", "payload_length").collect()
    assert len(rows) == 2000 and len({r["record_id"] for r in rows}) == 2000
    assert df.rdd.getNumPartitions() > 50 if split == 700 else True


def test_filters_are_pushed_down(spark, folder):
    df = spark.read.format("warc").load(folder)
    assert df.where(F.col("target_uri") == "http://h/7").count() == 1
    assert df.where(F.col("record_type") == "revisit").count() == 0
    assert df.where(F.col("target_uri").startswith("http://h/19")).count() == 111
    assert df.where(F.col("record_id").isin(PREFIX + "1", PREFIX + "2")).count() == 2
    assert df.where("payload_length > 0 and record_type = 'response'").count() == 2000
    headers = spark.read.format("warc").option("payload", "false").load(folder)
    assert headers.where("payload is not null").count() == 0 and headers.agg(F.min("payload_length")).first()[0] > 0


def test_unwanted_payloads_are_not_decoded(spark, folder, tmp_path):
    """A broken payload only hurts where it is wanted."""
    raw = bytearray()
    for k in range(3):
        m = bytearray(warc.member(warc.record("response", f"urn:x:{k}", f"http://h/{k}", None, None, bytes(range(256)) * 200)))
        if k == 1:
            m[len(m) // 2] ^= 0xFF
            m[len(m) // 2 + 1] ^= 0xFF
        raw += m
    (tmp_path / "a.warc.gz").write_bytes(bytes(raw))
    df = spark.read.format("warc").option("verify", "true").load(str(tmp_path))
    assert df.where("record_id = 'urn:x:2'").count() == 1
    with pytest.raises(Exception):
        df.where("record_id = 'urn:x:1'").collect()


def test_foreign_archives(spark, tmp_path):
    plain = b"".join(warc.record("response", f"urn:x:{k}", f"http://h/{k}", None, None, b"WARC/1.1\r\n\r\nbody %d" % k) for k in range(5))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record("response", f"urn:y:{k}", None, None, None, b"x" * k)) for k in range(4)))
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert len(rows) == 10
    assert sorted(r["payload_length"] for r in rows if r["record_id"].startswith("urn:y")) == [0, 1, 2, 3]
    assert next(bytes(r["payload"]) for r in rows if r["record_type"] == "warcinfo") == b"hello"
    assert {bytes(r["payload"]) for r in rows if r["record_id"].startswith("urn:x")} == {b"WARC/1.1\r\n\r\nbody %d" % k for k in range(5)}
