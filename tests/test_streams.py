"""Timers, branch joins, webhook logs and event logs: order, restarts and failures."""

from __future__ import annotations

import functools
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from placeloom.sources import feed
from placeloom.sources import tables as sources
from placeloom.streaming import branches, timers

EVENT = "post_id string, status string, error_message string, event_time timestamp"


def _add(spark, folder, rows):
    """Rows ``(post, status, second)`` as one more file."""
    made = spark.createDataFrame([(p, s, None, t) for p, s, t in rows], "post_id string, status string, error_message string, t long")
    made.select("post_id", "status", "error_message", F.timestamp_seconds("t").alias("event_time")).coalesce(1).write.mode("append").parquet(str(folder))


def _run(own, folder, known=None, **kw):
    changes = timers.follow(own.readStream.schema(EVENT).parquet(f"{folder}/in"), known, **kw)
    q = sources.to_folder(changes, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = own.read.schema(changes.schema).parquet(f"{folder}/out").select("post_id", "status", "previous", "error_message", F.unix_seconds("event_time").alias("t")).collect()
    return sorted(map(tuple, rows), key=repr), q


def test_timers_over_restarts(spark, tmp_path):
    own = timers.stateful_session(spark)
    know = own.createDataFrame([("k", "scraped", 50), ("done", "completed", 50), (None, "odd", 50)], "post_id string, status string, t long").select("post_id", "status", F.timestamp_seconds("t").alias("event_time"))
    kw = {"known": know, "give_up": "100 seconds", "remember": "1000 seconds", "late": "10 seconds"}
    _add(spark, tmp_path / "in", [("a", "scraping", 120), ("a", "pending", 100), ("a", "pending", 100), ("b", "pending", 100), ("b", "odd", 110), ("done", "pending", 120), (None, "pending", 100), ("x", None, 101)])
    got, _ = _run(own, tmp_path, **kw)
    first = [("a", "pending", None, None, 100), ("a", "scraping", "pending", None, 120), ("b", "pending", None, None, 100), (None, "pending", None, None, 100)]
    assert got == sorted(first, key=repr)
    # a gap that no timer has met yet counts by its own time; k timed out at 150, b at 200; a moved at 200
    _add(spark, tmp_path / "in", [("a", "scraped", 200), ("b", "completed", 230), ("c", "completed", 240)])
    got, _ = _run(own, tmp_path, **kw)
    second = [("a", "scraped", "scraping", None, 200), ("b", "failed", "pending", "timed out", 200), (None, "failed", "pending", "timed out", 200), ("k", "failed", "scraped", "timed out", 150), ("c", "completed", None, None, 240)]
    assert got == sorted(first + second, key=repr)
    # too late by the watermark (230): dropped; what is over stays over until it is forgotten
    _add(spark, tmp_path / "in", [("d", "pending", 150), ("k", "completed", 600), ("e", "pending", 600)])
    got, _ = _run(own, tmp_path, **kw)
    third = [("a", "failed", "scraped", "timed out", 300), ("e", "pending", None, None, 600)]
    assert got == sorted(first + second + third, key=repr)
    _add(spark, tmp_path / "in", [("k", "pending", 5000), ("e", "scraping", 5000)])
    got, _ = _run(own, tmp_path, **kw)
    _add(spark, tmp_path / "in", [("k", "pending", 5001)])  # forgotten by now, as the watermark is beyond
    got, q = _run(own, tmp_path, **kw)
    assert [g for g in got if g[0] == "k"] == [("k", "failed", "scraped", "timed out", 150), ("k", "pending", None, None, 5001)]
    assert ("e", "failed", "pending", "timed out", 700) in got and len([g for g in got if g[0] == "e"]) == 2


def test_state_of_timers_is_bounded(spark, tmp_path):
    """Posts that are over long ago leave no state."""
    own = timers.stateful_session(spark)
    for step in range(3):
        _add(spark, tmp_path / "in", [(f"p{step}-{k}", "completed", 10_000 * step + k) for k in range(50)])
        _, q = _run(own, tmp_path, give_up="100 seconds", remember="1000 seconds")
    left = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert left and left[-1] <= 2 * 60  # of the last fifty posts, a status and a timer each


def test_state_is_read_and_written_by_buckets(spark, tmp_path):
    """Calls for state, which cost most, don't grow with the posts: fewer rows of state than posts, and the same moves."""
    own = timers.stateful_session(spark)
    n = 12_000
    made = lambda status, shift: spark.range(n).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("error_message"), F.timestamp_seconds(F.col("id") % 100 + shift).alias("event_time"))
    known = made("pending", 50).where("post_id LIKE '%7'")
    for status, shift in (("scraping", 200), ("scraped", 400)):
        made(status, shift).write.mode("append").parquet(str(tmp_path / "in"))
        got, q = _run(own, tmp_path, known, give_up="1000 seconds", remember="1000 seconds")
        ops = [s for p in q.recentProgress for s in p["stateOperators"]]
        assert ops and max(s["numRowsTotal"] for s in ops) <= 2 * 4096 and sum(s["numRowsUpdated"] for s in ops) <= 4 * 4096
    want = [(f"p{k}", "scraping", "pending" if k % 10 == 7 else None, None, 200 + k % 100) for k in range(n)] + [(f"p{k}", "scraped", "scraping", None, 400 + k % 100) for k in range(n)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("buckets", [{}, {"buckets": 1}])
def test_posts_of_a_bucket_are_on_their_own(spark, tmp_path, buckets):
    """Time-outs before, at and after the watermark, a post that is forgotten beside others that aren't, null beside text."""
    own = timers.stateful_session(spark)
    know = own.createDataFrame([("k", "scraped", 20), ("o", "completed", 30), (None, "pending", 45), ("u", "odd", 1)], "post_id string, status string, t long").select("post_id", "status", F.timestamp_seconds("t").alias("event_time"))
    kw = {"known": know, "give_up": "100 seconds", "remember": "300 seconds", "late": "10 seconds"} | buckets
    _add(spark, tmp_path / "in", [("before", "pending", 99), ("at", "pending", 100), ("after", "pending", 105), ("z", "completed", 210)])
    got, _ = _run(own, tmp_path, **kw)
    first = [("before", "pending", None, None, 99), ("at", "pending", None, None, 100), ("after", "pending", None, None, 105), ("z", "completed", None, None, 210), ("before", "failed", "pending", "timed out", 199), ("k", "failed", "scraped", "timed out", 120), (None, "failed", "pending", "timed out", 145), ("at", "failed", "pending", "timed out", 200)]
    assert got == sorted(first, key=repr)  # the watermark is 200
    _add(spark, tmp_path / "in", [("o", "pending", 330), ("after", "scraping", 204), ("z", "failed", 345)])
    got, _ = _run(own, tmp_path, **kw)
    second = [("after", "scraping", "pending", None, 204), ("after", "failed", "scraping", "timed out", 304)]
    assert got == sorted(first + second, key=repr)
    _add(spark, tmp_path / "in", [("o", "pending", 341), ("z", "pending", 341), (None, "pending", 341), ("w", "pending", 700)])
    got, _ = _run(own, tmp_path, **kw)
    third = [("o", "pending", None, None, 341), ("o", "failed", "pending", "timed out", 441)]
    assert got == sorted(first + second + third + [("w", "pending", None, None, 700)], key=repr)


def test_ids_without_an_order_or_equality_are_refused(spark):
    events = spark.createDataFrame([], "post_id double, status string, error_message string, event_time timestamp")
    with pytest.raises(ValueError, match="post_id"):
        timers.follow(events)


@pytest.mark.parametrize("order", ["posts first", "answers first"])
def test_branches_in_any_order(spark, tmp_path, order):
    posts = [(k, 1000 + k) for k in range(40)] + [(-1, 100_000)]
    answers = [(k, 1000 + k + (700 if k % 5 == 0 else k), f"t{k}") for k in range(0, 40, 2)] + [(3, 900, "before its post"), (-1, 100_000, "end")]
    put = lambda rows, name, schema: spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("event_time")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        p, b = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("posts", "post_id long, event_time timestamp"), ("answers", "post_id long, event_time timestamp, text string")))
        q = sources.to_folder(branches.joined_branches(p, b), f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    steps = [("posts", posts[:-1], "post_id long, event_time long"), ("answers", answers[:-1], "post_id long, event_time long, text string")]
    spark.createDataFrame([], "post_id long, event_time timestamp").write.parquet(f"{tmp_path}/posts")
    spark.createDataFrame([], "post_id long, event_time timestamp, text string").write.parquet(f"{tmp_path}/answers")
    for name, rows, schema in steps if order == "posts first" else steps[::-1]:
        put(rows, name, schema)
        run()
    put(posts[-1:], "posts", steps[0][2])
    put(answers[-1:], "answers", steps[1][2])
    q = run()
    got = {r["post_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: f"t{k}" if k % 2 == 0 and k % 5 else None for k in range(40)} | {-1: "end"}
    assert [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1] <= 2  # the rows that end it


def test_state_of_branches_is_a_steps(spark, monkeypatch):
    """The query's state doesn't hold the whole table, and rows that meet over steps are as those that meet in one."""
    from placeloom.plans import streams

    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **kw: started.append(start(self, *a, **kw)) or started[-1])
    monkeypatch.setattr(branches, "steps_in_time", functools.partial(branches.steps_in_time, rows=4000))
    got = streams.branch_stream(spark, "/root/testdata/sf0.01").collect()
    want = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").selectExpr("o_orderkey", "IF(o_orderkey % 2 = 0 AND o_orderkey % 10 <> 4, o_orderstatus, null)", "IF(o_orderkey % 3 = 0 AND o_orderkey % 9 <> 6, o_orderpriority, null)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 15_000
    held = [s["numRowsTotal"] for q in started for p in q.recentProgress for s in p["stateOperators"]]
    assert len(started) == 8 and 4000 < max(held) < 8000  # all orders and texts are 22,500


@pytest.mark.parametrize("rows", [7, 30, 1000])
def test_tables_are_joined_in_steps(spark, tmp_path, rows):
    """Steps that cut between a post and its answer, steps without answers, several answers, ids that are null."""
    posts = [(k, 1000 + 40 * k) for k in range(60)] + [(None, 1500)]
    after = [0, 599, 600, 601, -1]
    answers = [(k, 1000 + 40 * k + after[k % 5], f"t{k}") for k in range(60) if k < 20 or k > 45] + [(3, 1130, "once more"), (None, 1500, "of none"), (999, 1500, "of no post")]
    made = lambda r, schema: spark.createDataFrame(r, schema).withColumn("event_time", F.timestamp_seconds("event_time"))
    p, b = made(posts, "post_id long, event_time long"), made(answers, "post_id long, event_time long, text string")
    upto = branches.steps_in_time(p, 10_000_000_000, rows=rows)
    assert len(upto) == -(-61 // rows) and upto == sorted(set(upto))
    got = branches.joined_in_steps(p, b, f"{tmp_path}/steps", upto)
    want = [(k, f"t{k}" if (k < 20 or k > 45) and k % 5 < 3 else None) for k in range(60) if k != 3] + [(3, "once more"), (None, None)]
    assert sorted(map(tuple, got.select("post_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables_are_joined_in_steps(spark, tmp_path):
    p = spark.createDataFrame([], "post_id string, event_time timestamp")
    b = p.withColumn("text", F.lit("x"))
    upto = branches.steps_in_time(p, 5)
    assert upto == [5] and branches.joined_in_steps(p, b, f"{tmp_path}/steps", upto, nobody="-").collect() == []


def _lines(reader, start, end):
    return [x for p in reader.partitions(start, end) for x in reader.read(p)]


def test_lines_of_growing_logs(tmp_path):
    """Ranges of any size give each whole line once; an unfinished line waits."""
    want = [f"line {k} " + "é" * (k % 7) for k in range(50)]
    (tmp_path / "a.log").write_text("\n".join(want[:20]) + "\n\n" + want[20])  # a closed log's last line needs no end
    (tmp_path / "b.log").write_text("\n".join(want[21:]) + "\nunfinis")
    (tmp_path / "_c.log").write_text("hidden\n")
    for size in (1, 7, 64, 10_000):
        reader = feed.LogStream(str(tmp_path), size)
        start, end = reader.initialOffset(), reader.latestOffset()
        got = _lines(reader, start, end)
        assert [x[2] for x in got] == want and len({x[:2] for x in got}) == 50
    with open(tmp_path / "b.log", "a") as f:
        f.write("hed\n")
    later = reader.latestOffset()
    assert [x[2] for x in _lines(reader, end, later)] == ["unfinished"] and _lines(reader, later, later) == []
    assert feed.LogStream(f"{tmp_path}/none", 5).latestOffset() == {"name": "", "bytes": 0}


def test_nothing_is_lost_or_repeated(spark, tmp_path):
    """Log lines become messages once, though the query fails between its commits and repeats a batch."""
    logs, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    logs.mkdir()

    def run():
        lines = feed.webhook_lines(spark, str(logs), 50).select(F.concat(F.lit("data: "), "line", F.lit("\n\n")).alias("message"))
        feed.write_events(lines, str(out), str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    def told():
        return sorted(r["message"][6:].strip() for r in feed.read_events(spark, str(out)).collect())

    (logs / "1.log").write_text("".join(f"a{k}\n" for k in range(30)))
    run()
    assert told() == sorted(f"a{k}" for k in range(30))
    with open(logs / "1.log", "a") as f:
        f.write("b0\nb1\n")
    (logs / "2.log").write_text("c0\n")
    run()
    whole = sorted([f"a{k}" for k in range(30)] + ["b0", "b1", "c0"])
    assert told() == whole
    # killed after the sink's commit, before the query's own: the batch is repeated
    last = max(int(n) for n in os.listdir(checkpoint / "commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (checkpoint / "commits" / name).exists():
            (checkpoint / "commits" / name).unlink()
    with open(logs / "2.log", "a") as f:
        f.write("d0\n")
    run()  # the repeated batch is all that this run takes
    assert told() == whole
    run()
    assert told() == sorted([*whole, "d0"])
    # killed before the sink's commit: files that no batch lists aren't read, and the batch is written again
    writer = feed.EventWriter(str(out))
    writer.write(iter([("data: ghost\n\n",)]))
    assert told() == sorted([*whole, "d0"])
    listed = json.loads((out / "batches" / "000000000000.json").read_text())
    writer.commit([writer.write(iter([("data: again\n\n",)]))], 0)
    assert told() == sorted([*whole, "d0"]) and json.loads((out / "batches" / "000000000000.json").read_text()) == listed
    assert feed.read_events(spark, f"{tmp_path}/nothing").count() == 0
