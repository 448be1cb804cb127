"""The status of posts as a log of events: in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.mutate import latest

#: Stages in order; a post never goes back. ``failed`` may come from any stage but the last.
STAGES = ["pending", "scraping", "scraped", "processing", "processing:media", "processing:analysis", "completed"]
FAILED = len(STAGES)


def rank(status: str | Column = "status") -> Column:
    """The place of a status in the order; unknown ones come before all."""
    status = F.col(status) if isinstance(status, str) else status
    out = F.when(status == "failed", FAILED)
    for k, name in enumerate(STAGES):
        out = out.when(status == name, k)
    return out.otherwise(-1)


def transitions(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Events whose status isn't that of the event before, with ``previous``."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).where(~F.col(status).eqNullSafe(F.col("previous")))


def current(events: DataFrame, key: str, status: Column, order: list[str]) -> DataFrame:
    """Of each key the event furthest in the order of stages, of those the latest; late and repeated events change nothing. No window: a hot key is reduced before the shuffle."""
    rest = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(status, *order)).alias("__row__")
    return events.groupBy(key).agg(best).select(key, "__row__.*")


def failure(stage: str | Column, message: str | Column, retryable: bool = True, code: str = "PIPELINE_ERROR") -> Column:
    """An error record as JSON."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.to_json(F.struct(as_column(stage).alias("failed_stage"), F.lit(code).alias("error_code"), F.lit(retryable).alias("retryable"), as_column(message).alias("error_message")))


def once_per_run(events: DataFrame, run: str = "run_id", at: str = "event_time", late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of a run's event within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([run, "status"])


def status_changes(events: DataFrame, give_up: str | None = "10 minutes", remember: str = "1 day") -> DataFrame:
    """A stream ``post_id, status, previous, error_message, event_time``: a row when a post moves on; repeats and steps back give none.

    Rows of a micro-batch are taken in time order. A post that doesn't move for ``give_up`` (processing time) fails. That
    a post is over is remembered for ``remember`` after its last event and then forgotten, so the state doesn't grow for
    ever; until then nothing makes the post begin again. Time-outs keep a stream running batches; without ``give_up``
    there are none, so a stream over a closed set of files ends, and its state lasts as long as it does.
    """
    ranks = {s: k for k, s in enumerate(STAGES)} | {"failed": FAILED}
    millis = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    wait, keep = millis(give_up) if give_up else None, millis(remember)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            if last in ("completed", "failed"):
                state.remove()
                return
            state.update(("failed",))
            state.setTimeoutDuration(keep)
            yield pd.DataFrame({"post_id": [key[0]], "status": ["failed"], "previous": [last], "error_message": ["timed out"], "event_time": [pd.Timestamp.now("UTC").tz_localize(None)]})
            return
        rows = pd.concat([b for b in batches if len(b)]).sort_values(["event_time", "status"], kind="stable")
        out = []
        for status, error, at in zip(rows["status"], rows["error_message"], rows["event_time"]):
            over = last in ("completed", "failed")
            if not over and ranks.get(status, -1) > ranks.get(last, -2):
                out.append((key[0], status, last, error, at))
                last = status
        state.update((last,))
        if wait:
            state.setTimeoutDuration(keep if last in ("completed", "failed") else wait)
        if out:
            yield pd.DataFrame(out, columns=["post_id", "status", "previous", "error_message", "event_time"])

    key_type = dict(events.dtypes)["post_id"]
    schema = f"post_id {key_type}, status string, previous string, error_message string, event_time timestamp"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return events.groupBy("post_id").applyInPandasWithState(step, schema, "last string", "append", timeout)


def cached_answers(asked: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """A stream of asked keys with the completed post (a static table, one row per key) where there is one."""
    return asked.join(completed.withColumn("cached", F.lit(True)), key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def merge_branches(posts: DataFrame, key: str, *branches: DataFrame) -> DataFrame:
    """Posts with the columns of independent branches; a branch that has nothing for a post leaves nulls."""
    for branch in branches:
        posts = posts.join(branch, key, "left")
    return posts


def steps_shown(steps: DataFrame, post: str, step: str, *columns: str) -> DataFrame:
    """``post, steps``: the steps of each post (one row a step, see ``mutate.upsert``) in the order of their numbers."""
    return steps.groupBy(post).agg(F.array_sort(F.collect_list(F.struct(step, *columns))).alias("steps"))


def latest_batches(folder: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``apply_batches``: writes a micro-batch's last row of each key under its number, so a repeated batch replaces what it wrote before."""

    def apply(rows: DataFrame, number: int) -> None:
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return apply


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch goes to ``apply(rows, number)``; the number lets it be skipped when repeated."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def new_profiles(users: DataFrame) -> DataFrame:
    """Profiles of new users (``id, raw_user_meta_data`` as JSON text, ``phone``): the full name, else 'Explorer'."""
    return users.select("id", F.coalesce(F.get_json_object("raw_user_meta_data", "$.full_name"), F.lit("Explorer")).alias("display_name"), "phone")
