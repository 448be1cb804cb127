"""Queries that run as streams over folders until they have read all, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATUS_EVENT
from ..sources import feed
from ..sources import tables as sources
from ..streaming import branches, status, timers
from .analogues import read
from .register import query
from .rows import _STAGE

_RANK = "CASE s WHEN 'pending' THEN 0 WHEN 'scraping' THEN 1 WHEN 'scraped' THEN 2 WHEN 'completed' THEN 6 ELSE 7 END"


@query(
    f"""WITH e AS (SELECT *, {_RANK} AS r FROM (SELECT user_id * 16 + event_id % 16 AS user_id, epoch_us(ts) AS t, {_STAGE} AS s FROM events)),
b AS (SELECT max(t) AS hi, min(t) + (max(t) - min(t)) // 3 AS cut FROM e),
start AS (SELECT user_id, arg_max(s, (r, t)) AS s, max(r) AS r, arg_max(t, (r, t)) AS t FROM e, b WHERE t <= cut GROUP BY user_id),
later AS (SELECT e.*, coalesce(greatest(max(e.r) OVER (PARTITION BY e.user_id ORDER BY e.t, e.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start.r), start.r, -1) AS before FROM b, e LEFT JOIN start USING (user_id) WHERE e.t > cut),
seq AS (SELECT user_id, t, s, r, true AS old FROM start UNION ALL SELECT user_id, t, s, r, false FROM later WHERE r > before AND before < 6),
steps AS (SELECT *, lag(s) OVER w AS previous, lead(t) OVER w AS next FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY t, s)),
outs AS (SELECT user_id, s, t + 432000000000 AS t FROM steps, b WHERE r < 6 AND (next >= t + 432000000000 OR next IS NULL AND (t + 432000000000 + 999) // 1000 <= hi // 1000 - 10000)),
first AS (SELECT user_id, min(t) AS t, arg_min(s, t) AS s FROM outs GROUP BY user_id)
SELECT user_id AS post_id, steps.s AS status, previous, CAST(NULL AS VARCHAR) AS error_message, steps.t AS event_time FROM steps LEFT JOIN first USING (user_id) WHERE NOT old AND (first.t IS NULL OR steps.t < first.t)
UNION ALL SELECT user_id, 'failed', s, 'timed out', t FROM first"""
)
def status_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Events as statuses of sixteen posts a user: the first third of the time is a stored table, the others a stream that is stopped between them. Five days without a move are a failure."""
    folder = sources.scratch_folder(spark, "timeouts")
    e = read(spark, d, "events").select((F.col("user_id") * 16 + F.col("event_id") % 16).alias("post_id"), F.expr(_STAGE).alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("ts").cast("timestamp").alias("event_time"))
    at = F.unix_micros("event_time")
    low, high = e.agg(F.min(at), F.max(at)).first()
    if low is None:
        low = high = 0
    cuts = [low + (high - low) // 3, low + 2 * (high - low) // 3]
    status.current(e.where(at <= cuts[0]), "post_id", status.rank(), ["event_time"]).write.parquet(f"{folder}/known")
    own = timers.stateful_session(spark)
    for part in (e.where((at > cuts[0]) & (at <= cuts[1])), e.where(at > cuts[1])):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(e.schema).parquet(f"{folder}/in")
        changes = timers.follow(stream, own.read.schema(e.schema).parquet(f"{folder}/known"), "5 days", "400 days")
        sources.to_folder(changes, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{folder}/out").withColumn("event_time", F.unix_micros("event_time"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey * 1000 AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS ocr, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS said FROM orders)
SELECT id, CASE WHEN id % 10 <> 4 THEN ocr END AS ocr, CASE WHEN id % 9 <> 6 THEN said END AS said FROM o"""
)
def branch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as posts, second by second; half get a text, a third get speech, some of them too late. The streams get them in steps, so a text or speech may come steps after its post."""
    folder, key = sources.scratch_folder(spark, "branches"), F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    time = lambda after: F.timestamp_seconds(key + 1_000_000 + after).alias("event_time")
    ocr = o.where("o_orderkey % 2 = 0").select(key.alias("post_id"), time(F.when(key % 10 == 4, 1000).otherwise(key % 600)), F.col("o_orderstatus").alias("ocr"))
    said = o.where("o_orderkey % 3 = 0").select(key.alias("post_id"), time(F.when(key % 9 == 6, 601).otherwise(0)), F.col("o_orderpriority").alias("said"))
    posts = o.select(key.alias("post_id"), time(F.lit(0)))
    upto = branches.steps_in_time(posts, beyond=100_000_000_000)
    whole = posts
    for name, branch in (("ocr", ocr), ("said", said)):
        whole = branches.joined_in_steps(whole, branch, f"{folder}/{name}", upto, within="600 seconds")
    return whole.select(F.col("post_id").alias("id"), "ocr", "said")


@query(
    """SELECT event_id, 'event: ' || CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE event_type END || chr(10) || 'data: {"post_id":"' || user_id || '","status":"' || CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END || '","error_message":"' || event_id || '"}' || chr(10) || chr(10) AS message FROM events"""
)
def webhook_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as webhook logs, read as a stream, answered as event-stream messages in a log, read back."""
    folder = sources.scratch_folder(spark, "webhooks")
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("post_id"), kind.alias("status"), F.col("event_id").cast("string").alias("error_message"), F.col("ts").cast("timestamp").alias("event_time")))
    read(spark, d, "events").select(body).write.text(f"{folder}/logs")
    parsed = feed.webhook_lines(spark, f"{folder}/logs", 1 << 20).select(F.from_json("line", STATUS_EVENT).alias("e")).select("e.*")
    feed.write_events(sources.server_events(parsed).select("message"), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return feed.read_events(spark, f"{folder}/out").select(F.regexp_extract("message", r'"error_message":"(\d+)"', 1).cast("long").alias("event_id"), "message")
