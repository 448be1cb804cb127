"""Queries of crawled datasets, uploads and what their runs report, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, mutate, normalize
from ..schemas import CRAWL_EVENT
from ..sources import tables as sources
from ..streaming import status
from .analogues import read
from .register import ORACLE_SQL, query
from .rows import instagram_documents, post_columns


@query(ORACLE_SQL["instagram_posts"])
def crawled_posts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a crawl's dataset of JSON lines, some of them cut off, read back and normalised."""
    folder = sources.scratch_folder(spark, "dataset")
    whole = instagram_documents(spark, d)
    whole.unionByName(whole.where("crc32(doc) % 3 = 0").select(F.expr("substr(doc, 1, length(doc) - 1)").alias("doc"))).write.text(folder)
    return post_columns(normalize.instagram(sources.crawled(spark, folder, "instagram").where("shortCode IS NOT NULL")))


@query("SELECT event_id::VARCHAR AS run_id, event_type AS status, 'd' || value::BIGINT AS dataset_id, user_id::VARCHAR AS post_id, epoch_us(ts) AS event_time FROM events")
def crawl_events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events as reports of runs, half of them sent again: the stream is stopped between its parts, the second brings reports of the first again."""
    folder = sources.scratch_folder(spark, "crawl-events")
    dataset = F.concat(F.lit("d"), F.bround("value").cast("long").cast("string"))
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), dataset.alias("dataset_id"), F.col("user_id").cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("event_time"))
    at = F.unix_micros("event_time")
    low, high = e.agg(F.min(at), F.max(at)).first()
    cut = (low + high) // 2 if low is not None else 0
    again = e.where(F.crc32("run_id") % 2 == 0)
    for part in (e.where(at <= cut).unionByName(again.where(at <= cut)), e.where(at > cut).unionByName(again)):
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
        once = status.once_per_run(sources.crawl_events(spark, f"{folder}/in"), late="10 minutes")
        sources.to_folder(once, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CRAWL_EVENT).parquet(f"{folder}/out").withColumn("event_time", F.unix_micros("event_time"))


@query(
    """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'text/plain' END AS mime, 'd' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.WAV' ELSE '.txt' END AS name, n_chars * 100000 AS size FROM documents)
SELECT doc_id, CASE WHEN (coalesce(mime = 'audio/mpeg', false) OR name LIKE '%.WAV') AND size <= 52428800 THEN 'audios/' || doc_id * 1001 || '-' || name END AS storage_key FROM f"""
)
def upload_keys(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploaded files: where those that may be stored are stored, and those that are refused."""
    key = F.col("doc_id")
    name = F.concat(F.lit("d"), key.cast("string"), F.when(key % 4 == 0, ".WAV").otherwise(".txt")).alias("file_name")
    mime = F.when(key % 3 == 0, "audio/mpeg").when(key % 3 == 1, "text/plain").alias("mime_type")
    files = read(spark, d, "documents").select("doc_id", mime, name, (F.col("n_chars") * 100000).alias("size_bytes"), F.timestamp_millis(key * 1001).alias("created_at"))
    stored, refused = sources.uploads(files)
    return stored.select("doc_id", sources.storage_key().alias("storage_key")).unionByName(refused.select("doc_id", F.lit(None).cast("string").alias("storage_key")))


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn, text), '|') AS texts FROM conversations GROUP BY conv_id")
def texts_in_frame_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns as results of frames, which come back out of order."""
    came = read(spark, d, "conversations").repartition(F.xxhash64("conv_id", "turn", "text"))
    return frames.in_frame_order(came, "conv_id", "turn", "text").select("conv_id", F.array_join("texts", "|").alias("texts"))


_STEP = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"


@query(
    f"""WITH last AS (SELECT user_id, {_STEP} AS step, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL)
SELECT user_id AS post_id, string_agg(step || ':' || event_id, ',' ORDER BY step) AS steps FROM last GROUP BY user_id"""
)
def steps_of_posts(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps of a post: a later one replaces that of its number, the others are added, all in order."""
    e = read(spark, d, "events").select(F.col("user_id").alias("post_id"), F.expr(_STEP).alias("step"), "ts", "event_id")
    half = e.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).alias("half"))
    marked = e.crossJoin(F.broadcast(half))  # one row
    shown = mutate.latest(marked.where("ts <= half").drop("half"), ["post_id", "step"], ["ts", "event_id"])
    steps = mutate.upsert(shown, marked.where("ts > half").drop("half"), ["post_id", "step"], ["ts", "event_id"])
    told = F.transform("steps", lambda x: F.concat(x["step"].cast("string"), F.lit(":"), x["event_id"].cast("string")))
    return status.steps_shown(steps, "post_id", "step", "event_id").select("post_id", F.array_join(told, ",").alias("steps"))


@query("SELECT user_id AS post_id, arg_max(event_type, (ts, event_id)) AS status, max(epoch_us(ts)) AS event_time FROM events GROUP BY user_id")
def polled_status(spark: SparkSession, d: str) -> DataFrame:
    """What polling sees: events as a stream in micro-batches, of each only the last status of a post; a batch written twice counts once."""
    folder = sources.scratch_folder(spark, "polled")
    e = read(spark, d, "events").select(F.col("user_id").alias("post_id"), F.col("event_type").alias("status"), "event_id", F.col("ts").cast("timestamp").alias("event_time"))
    e.repartition(8, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    order = ["event_time", "event_id"]
    status.apply_batches(stream, status.latest_batches(f"{folder}/out", ["post_id"], order), f"{folder}/checkpoint", once=True).awaitTermination()
    seen = spark.read.schema(e.schema).parquet(f"{folder}/out")
    return mutate.latest(seen, ["post_id"], order).select("post_id", "status", F.unix_micros("event_time").alias("event_time"))
