"""Sources and sinks: stored tables, crawled JSON, media files and event folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.media import may_upload
from ..schemas import CRAWL_EVENT, INSTAGRAM, STATUS_EVENT, TABLES, TIKTOK


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def write_table(rows: DataFrame, folder: str, name: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """A stored table; posts are worth partitioning by platform."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/{name}")


def with_new_ids(rows: DataFrame, name: str = "id") -> DataFrame:
    """Rows with random ids. Store them before they are used twice: another run gives others."""
    return rows.withColumn(name, F.expr("uuid()")).withColumn("created_at", F.current_timestamp())


def crawled(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Raw posts of ``instagram`` or ``tiktok``, a JSON document each line; broken lines are dropped by their null fields."""
    return spark.read.schema({"instagram": INSTAGRAM, "tiktok": TIKTOK}[source]).json(path)


def first_item(dataset: DataFrame):
    """The one document of a crawl's dataset; an empty dataset raises LookupError."""
    rows = dataset.limit(1).collect()
    if not rows:
        raise LookupError("the dataset is empty")
    return rows[0]


def media_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of media files; select without ``content`` and no byte is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def uploads(files: DataFrame, mime: str = "mime_type") -> tuple[DataFrame, DataFrame]:
    """Files that may be stored as audio, and those that are refused."""
    ok = may_upload(mime, "file_name", "size_bytes")
    return files.where(ok), files.where(~ok)


def storage_key(name: str = "file_name", at: str = "created_at") -> Column:
    """Where an upload is stored: folder, time in milliseconds, name."""
    return F.concat(F.lit("audios/"), F.unix_millis(F.col(at)).cast("string"), F.lit("-"), F.col(name))


def crawl_events(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """A stream of crawl events, JSON files in a folder."""
    return spark.readStream.schema(CRAWL_EVENT).option("maxFilesPerTrigger", most_files).json(folder)


def status_events(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(STATUS_EVENT).option("maxFilesPerTrigger", most_files).json(folder)


def server_events(changes: DataFrame) -> DataFrame:
    """Status changes as event-stream text: the event's name, its data as JSON, an empty line."""
    stage = F.element_at(F.split("status", ":"), 1)
    event = F.when(F.col("status") == "completed", "complete").when(F.col("status") == "failed", "error").otherwise(stage)
    data = F.to_json(F.struct("post_id", "status", "error_message"))
    return changes.select("post_id", F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n")).alias("message"))


def to_folder(stream: DataFrame, path: str, checkpoint: str, trigger: str = "2 seconds") -> DataStreamWriter:
    """An append stream to Parquet files; each micro-batch is written once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=trigger)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="placeloom-")
    return f"{shared.rstrip('/')}/placeloom-{name}-{uuid.uuid4().hex}"
