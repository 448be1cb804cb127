"""Streams over replayed files, against the answer in batch."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from placeloom.sources import tables as sources
from placeloom.streaming import status


def _write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def _event(post, state, minute, run="r"):
    return {"post_id": post, "status": state, "error_message": None, "run_id": run, "dataset_id": "d", "event_time": f"2024-01-01T00:{minute:02d}:00Z"}


def _until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.3)
    return done()


def test_status_in_batch(spark):
    rows = [("a", "pending", 1), ("a", "scraped", 2), ("a", "scraped", 3), ("a", "scraping", 4), ("b", "failed", 1), ("b", "odd", 2)]
    e = spark.createDataFrame(rows, "post_id string, status string, t int")
    assert [tuple(r) for r in status.transitions(e, "post_id", "status", ["t"]).select("post_id", "t").orderBy("post_id", "t").collect()] == [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)]
    now = status.current(e, "post_id", status.rank("status"), ["t"]).orderBy("post_id").collect()
    assert [(r["post_id"], r["status"], r["t"]) for r in now] == [("a", "scraped", 3), ("b", "failed", 1)]
    record = json.loads(e.limit(1).select(status.failure("media", "boom")).first()[0])
    assert record == {"failed_stage": "media", "error_code": "PIPELINE_ERROR", "retryable": True, "error_message": "boom"}


@pytest.mark.parametrize("mixed", [False, True])
def test_status_stream_equals_the_batch(spark, tmp_path, mixed):
    events = [_event("a", "pending", 1), _event("a", "scraping", 2), _event("a", "scraped", 3), _event("a", "scraped", 4), _event("a", "processing:media", 5), _event("a", "scraped", 6), _event("a", "completed", 7), _event("b", "pending", 1), _event("b", "failed", 2), _event("b", "scraped", 3)]
    if mixed:
        events = events[::-1]
    _write(tmp_path / "in", "one.json", events[:5])
    _write(tmp_path / "in", "two.json", events[5:])
    changes = status.status_changes(sources.status_events(spark, str(tmp_path / "in"), 1), give_up=None)
    name = f"changes_{mixed}"
    q = changes.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(name)
    last = {r["post_id"]: r["status"] for r in status.current(got, "post_id", status.rank("status"), ["event_time"]).collect()}
    assert last == {"a": "completed", "b": "failed"}
    if not mixed:
        assert [r["status"] for r in got.where("post_id = 'a'").orderBy("event_time").collect()] == ["pending", "scraping", "scraped", "processing:media", "completed"]
    messages = [r["message"] for r in sources.server_events(got).collect()]
    assert any(m.startswith("event: complete\ndata: {") and m.endswith("\n\n") for m in messages)


def test_a_post_that_timed_out_does_not_begin_again(spark, tmp_path):
    _write(tmp_path / "in", "one.json", [_event("a", "pending", 1), _event("a", "scraping", 2), _event("b", "completed", 1)])
    changes = status.status_changes(sources.status_events(spark, str(tmp_path / "in"), 1), give_up="1 second", remember="1 hour")
    q = changes.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    shown = lambda n: _until(lambda: spark.table("timed").count() >= n)
    assert shown(4)  # the time-out is one of them
    _write(tmp_path / "in", "two.json", [_event("a", "pending", 3), _event("a", "scraped", 4), _event("b", "pending", 5), _event("c", "failed", 6)])
    assert shown(5)
    q.stop()
    got = [(r["post_id"], r["status"]) for r in spark.table("timed").collect()]
    assert sorted(got) == [("a", "failed"), ("a", "pending"), ("a", "scraping"), ("b", "completed"), ("c", "failed")]


def test_repeated_runs_count_once(spark, tmp_path):
    _write(tmp_path / "in", "one.json", [_event("a", "SUCCEEDED", 1, "r1"), _event("a", "SUCCEEDED", 2, "r1"), _event("b", "SUCCEEDED", 2, "r2")])
    _write(tmp_path / "in", "two.json", [_event("a", "SUCCEEDED", 3, "r1")])
    once = status.once_per_run(sources.crawl_events(spark, str(tmp_path / "in"), 1))
    q = sources.to_folder(once, str(tmp_path / "out"), str(tmp_path / "cp"), "0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["run_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r1", "r2"]


def test_cached_answers_and_batches(spark, tmp_path):
    _write(tmp_path / "in", "one.json", [_event("a", "x", 1), _event("b", "x", 1)])
    done = spark.createDataFrame([("a", "p1")], "post_id string, place string")
    stream = status.cached_answers(sources.status_events(spark, str(tmp_path / "in")), done, "post_id")
    seen: list[tuple] = []
    q = status.apply_batches(stream, lambda rows, n: seen.extend((r["post_id"], r["cached"]) for r in rows.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == [("a", True), ("b", False)]


def test_profiles_of_new_users(spark):
    users = spark.createDataFrame([("1", '{"full_name":"Ann"}', "5"), ("2", "{}", None), ("3", None, None)], "id string, raw_user_meta_data string, phone string")
    assert [r["display_name"] for r in status.new_profiles(users).orderBy("id").collect()] == ["Ann", "Explorer", "Explorer"]


def test_branches(spark):
    posts = spark.createDataFrame([(1,), (2,)], "id long")
    ocr, said = posts.where("id = 1").withColumn("ocr", F.lit("x")), posts.where("id = 2").withColumn("said", F.lit("y"))
    assert [tuple(r) for r in status.merge_branches(posts, "id", ocr, said).orderBy("id").collect()] == [(1, "x", None), (2, None, "y")]


def test_sources(spark, tmp_path):
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "frame_0002.jpg").write_bytes(b"abc")
    files = sources.media_files(spark, str(tmp_path / "frames"), "*.jpg")
    assert files.select("length").first()[0] == 3
    with pytest.raises(LookupError):
        sources.first_item(spark.range(0))
    assert sources.first_item(spark.range(1))["id"] == 0
    sources.write_table(sources.with_new_ids(spark.createDataFrame([("u", "p")], "user_id string, place_id string")), str(tmp_path), "saved_places")
    assert sources.read_table(spark, str(tmp_path), "saved_places").first()["user_id"] == "u"
    f = spark.createDataFrame([("audio/ogg", "a.b", 1), ("text/plain", "c.txt", 1)], "mime_type string, file_name string, size_bytes long").withColumn("created_at", F.timestamp_seconds(F.lit(2)))
    good, bad = sources.uploads(f)
    assert good.select(sources.storage_key()).first()[0] == "audios/2000-a.b" and bad.count() == 1


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 1), (None, "z", 3)], "post_id string, status string, at int")
    apply = status.latest_batches(str(tmp_path / "out"), ["post_id"], ["at"])
    for _ in range(2):
        apply(rows, 7)
    apply(rows.where("false"), 8)
    got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("a", "y", 2), ("b", None, 1), (None, "z", 3)], key=repr)


def test_steps_in_order(spark):
    steps = spark.createDataFrame([("a", 2, "done"), ("a", 10, None), ("a", 1, "done"), ("b", None, "new")], "post string, step int, status string")
    got = {r["post"]: [tuple(x) for x in r["steps"]] for r in status.steps_shown(steps, "post", "step", "status").collect()}
    assert got == {"a": [(1, "done"), (2, "done"), (10, None)], "b": [(None, "new")]}
