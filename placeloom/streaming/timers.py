"""The status of posts as keyed state with timers in event time.

A post moves on through the stages and never back. One that doesn't move for a while fails, at its
last move's time plus that while, however late that is noticed; what is over is forgotten after
another while. Both are timers of the watermark, so a replay gives the same rows. A stream can begin
from a stored table of states. The state lies in RocksDB. Each call that reads or writes it costs a
worker far more than a row does, so the key is a bucket of posts: one value holds a bucket's posts,
and one timer is set for that which is due first. Rows of a bucket in one micro-batch are taken in
time order, so a trigger's size bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, DecimalType, FractionalType, MapType, StructType

from .status import FAILED, STAGES

_RANK = {s: k for k, s in enumerate(STAGES)} | {"failed": FAILED}
_OVER = ("completed", "failed")
#: Buckets of posts: a million posts are some 250 a bucket.
BUCKETS = 4096
CHANGE = "post_id {}, status string, previous string, error_message string, event_time timestamp"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose streams keep their state in RocksDB, as timers need."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def _micros(at: Any) -> int:
    return pd.Timestamp(at).value // 1000


class Follow(StatefulProcessor):
    """A bucket of posts: for each its status and when it moved there (microseconds)."""

    def __init__(self, give_up: str, remember: str, kind: str) -> None:
        self.wait, self.keep = (pd.Timedelta(x).value // 1000 for x in (give_up, remember))
        self.schema = f"post_id array<{kind}>, status array<string>, moved array<long>, timer long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("posts", self.schema)

    def _due(self, status: str, moved: int) -> int:
        """Milliseconds of the watermark at which a post fails or is forgotten."""
        return -(-(moved + (self.keep if status in _OVER else self.wait)) // 1000)

    def _get(self) -> tuple[dict, int | None]:
        """The bucket's posts, and the time that its timer is set to."""
        if (value := self.state.get()) is None:
            return {}, None
        ids, statuses, moved, timer = value
        return dict(zip(ids, zip(statuses, moved))), timer

    def _put(self, posts: dict, timer: int | None, after: int | None = None) -> None:
        first = min((self._due(*p) for p in posts.values()), default=None)
        if first is not None and after is not None:
            first = max(first, after + 1)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if posts:
            self.state.update((list(posts), [s for s, _ in posts.values()], [m for _, m in posts.values()], first))
        else:
            self.state.clear()

    @staticmethod
    def _row(post: Any, status: str, previous: str | None, error: str | None, at: int) -> Row:
        return Row(post_id=post, status=status, previous=previous, error_message=error, event_time=pd.Timestamp(at, unit="us", tz="UTC").to_pydatetime())

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        posts = {p["post_id"]: (p["status"], p["moved"]) for p in initialState["posts"] if p["status"] in _RANK}
        if posts:
            self._put(posts, None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        posts, timer = self._get()
        moves = False
        for at, to, post, error in sorted(((_micros(r["event_time"]), r["status"] or "", r["post_id"], r["error_message"]) for r in rows if r["event_time"] is not None), key=lambda x: x[:2]):
            status, moved = before = posts.get(post, (None, 0))
            if status and status not in _OVER and at >= moved + self.wait:
                moved += self.wait
                yield self._row(post, "failed", status, "timed out", moved)
                status = "failed"
            if status not in _OVER and _RANK.get(to, -1) > _RANK.get(status, -1):
                yield self._row(post, to, status, error, at)
                status, moved = to, at
            if (status, moved) != before:
                posts[post] = status, moved
                moves = True
        if moves:
            self._put(posts, timer)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        posts, timer = self._get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        until = max(fired, timerValues.getCurrentWatermarkInMs())
        for post, (status, moved) in list(posts.items()):
            if self._due(status, moved) > until:
                continue
            if status in _OVER:
                del posts[post]
            else:
                yield self._row(post, "failed", status, "timed out", moved + self.wait)
                posts[post] = "failed", moved + self.wait
        self._put(posts, timer, fired)  # what is due once more waits for the next micro-batch; the timer that fired is removed after this

    def close(self) -> None:
        pass


def follow(events: DataFrame, known: DataFrame | None = None, give_up: str = "10 minutes", remember: str = "1 day", late: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream ``post_id, status, previous, error_message, event_time`` of the moves of posts and of their time-outs.

    ``events`` (of a ``stateful_session``) has ``post_id, status, error_message, event_time``; what comes ``late`` behind the
    latest is dropped. ``known`` is a table of the posts' states before the stream's first event. Repeats, steps back
    and unknown statuses give no row; rows without a time are skipped; null ids are one post. Ids are of a plain type, no
    floats. A micro-batch reads and writes the ``buckets`` that its rows fall into as a whole; a checkpoint holds for its number only.
    """
    kind = events.schema["post_id"].dataType
    if isinstance(kind, (FractionalType, ArrayType, MapType, StructType)) and not isinstance(kind, DecimalType):
        raise ValueError(f"post_id can't be {kind.simpleString()}")
    bucket = F.pmod(F.xxhash64("post_id"), F.lit(buckets)).alias("bucket")
    rows = events.select(bucket, "post_id", "status", "error_message", "event_time").withWatermark("event_time", late)
    before = None
    if known is not None:
        post = F.struct("post_id", "status", F.unix_micros("event_time").alias("moved"))
        before = known.where("event_time IS NOT NULL").withColumn("post_id", F.col("post_id").cast(kind)).groupBy(bucket).agg(F.collect_list(post).alias("posts")).groupBy("bucket")
    return rows.groupBy("bucket").transformWithState(Follow(give_up, remember, kind.simpleString()), CHANGE.format(kind.simpleString()), "append", "EventTime", before)
