"""Independent branches of a post's processing, joined as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import tables as sources

#: Posts of a step, about, which the state of a join of tables holds, and the most partitions that they are dealt over: each takes time in every step.
STEP, PARTITIONS = 6_000_000, 48


def joined_branches(posts: DataFrame, branch: DataFrame, key: str = "post_id", at: str = "event_time", within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """The stream of posts with the columns of a branch's stream; posts and answers may come in any order.

    An answer counts from its post's time to ``within`` after it. A post without one gets nulls once the watermarks of both
    streams (``late`` behind the latest row) are beyond that, so the state holds what is younger only. Several answers
    give a row each; null keys meet none. Branches are joined one after another, each in a query of its own.
    """
    own = branch.select(F.col(key).alias("__key__"), F.col(at).alias("__at__"), *[c for c in branch.columns if c not in (key, at)]).withWatermark("__at__", late)
    left = posts.withWatermark(at, late)
    near = (F.col("__at__") >= F.col(at)) & (F.col("__at__") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(own, (F.col(key) == F.col("__key__")) & near, "left_outer").drop("__key__", "__at__")


def steps_in_time(posts: DataFrame, beyond: int, at: str = "event_time", rows: int = STEP) -> list[int]:
    """The last microsecond of each step of about so many posts; the last step ends ``beyond`` microseconds after the last post."""
    time = F.unix_micros(at)
    n, high = posts.agg(F.count("*"), F.max(time)).first()
    steps = -(-n // rows)
    cuts = posts.agg(F.percentile_approx(time, [k / steps for k in range(1, steps)])).first()[0] if steps > 1 else []
    return sorted({c for c in cuts or [] if c < high}) + [(high or 0) + beyond]


def _lean_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose streams hold one version of their state, and store it as a whole often, as a step goes on from there."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    own.conf.set("spark.sql.streaming.maxBatchesToRetainInMemory", "1")
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    own.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", "2")
    return own


def joined_in_steps(posts: DataFrame, branch: DataFrame, folder: str, upto: list[int], nobody: int | str = -1, key: str = "post_id", at: str = "event_time", **kw: str) -> DataFrame:
    """Two tables joined as streams (``joined_branches``) that get them in steps, in the order of time; so the state holds a step's rows, however large the tables are.

    ``upto`` are the steps' ends (``steps_in_time``). Each step ends with a row of ``nobody``, an id of no post, in both
    streams, which tells that they have got so far. The query is stopped between steps and goes on from its checkpoint.
    """
    spark, tables = posts.sparkSession, {"posts": posts, "branch": branch}
    own = _lean_session(spark)
    step = F.lit(0)
    for end in upto[:-1]:
        step += F.coalesce((F.unix_micros(at) > end).cast("int"), F.lit(0))
    for name, rows in tables.items():
        rows.withColumn("__step__", step).write.partitionBy("__step__").parquet(f"{folder}/{name}")
    for k, end in enumerate(upto):
        mark = spark.range(1).select(F.lit(nobody).cast(posts.schema[key].dataType).alias(key), F.timestamp_micros(F.lit(end)).alias(at))
        streams = []
        for name, rows in tables.items():
            stored = spark.read.schema(StructType([*rows.schema, StructField("__step__", IntegerType())])).parquet(f"{folder}/{name}")
            stored.where(F.col("__step__") == k).drop("__step__").unionByName(mark, allowMissingColumns=True).write.mode("append").parquet(f"{folder}/in/{name}")
            streams.append(own.readStream.schema(rows.schema).parquet(f"{folder}/in/{name}"))
        joined = joined_branches(*streams, key=key, at=at, **kw)
        sources.to_folder(joined, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{folder}/out").where(~F.col(key).eqNullSafe(nobody))
