"""Queries on posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import frame_budget
from .mutate import latest

#: Columns that a place lends to its post.
PLACE_COLUMNS = {"name": "place_name", "city": "place_city", "neighborhood": "place_neighborhood", "category": "place_category", "latitude": "latitude", "longitude": "longitude", "address": "place_address"}


def enriched(posts: DataFrame, places: DataFrame, place_id: str = "place_id", key: str = "id", columns: dict[str, str] | None = None) -> DataFrame:
    """Posts with the columns of their place, null where there is none."""
    side = places.select(F.col(key).alias("__place__"), *[F.col(a).alias(b) for a, b in (columns or PLACE_COLUMNS).items()])
    return posts.join(side, F.col(place_id) == F.col("__place__"), "left").drop("__place__")


def pick_post(posts: DataFrame, group: list[str], status: str = "status", created: str = "created_at", key: str = "id", done: str = "completed") -> DataFrame:
    """Of each group's posts the newest that is done, else the newest."""
    done_last = posts.withColumn("__done__", F.col(status).eqNullSafe(done))
    return latest(done_last, group, ["__done__", created, key]).drop("__done__")


def places_of_posts(posts: DataFrame, places: DataFrame, post_key: str = "id", place_id: str = "place_id", url: str = "post_url", place_key: str = "id", source_url: str = "source_url") -> DataFrame:
    """``post_id, place_id, rank``: the post's own place (0), then those found under its URL (1), each place once."""
    own = posts.select(F.col(post_key).alias("post_id"), F.col(place_id).alias("place_id"), F.lit(0).alias("rank")).where("place_id is not null")
    own = own.join(places.select(F.col(place_key).alias("place_id")), "place_id", "left_semi").select("post_id", "place_id", "rank")
    found = posts.select(F.col(post_key).alias("post_id"), F.col(url).alias("__url__")).where("__url__ is not null")
    found = found.join(places.select(F.col(source_url).alias("__url__"), F.col(place_key).alias("place_id")), "__url__").select("post_id", "place_id", F.lit(1).alias("rank"))
    # the least rank, by aggregation: a post with many places needs no window
    return own.unionByName(found).groupBy("post_id", "place_id").agg(F.min("rank").alias("rank"))


def top_engagement(posts: DataFrame, k: int, rate: str = "engagement_rate", key: str = "id") -> DataFrame:
    return posts.orderBy(F.col(rate).desc_nulls_last(), F.col(key)).limit(k)


def with_tag(posts: DataFrame, tag: str, tags: str = "hashtags") -> DataFrame:
    return posts.where(F.array_contains(tags, tag))


def frame_plan(posts: DataFrame, duration: str, key: str = "id") -> DataFrame:
    """``key, frames``: how many frames a post's video gives."""
    return posts.select(key, frame_budget(duration).alias("frames"))


def uncached(asked: DataFrame, posts: DataFrame, key: Column, post_key: Column, status: str = "status") -> DataFrame:
    """Asked URLs without a completed post: only these go on to the expensive stages."""
    done = posts.where(F.col(status) == "completed").select(post_key.alias("__key__")).distinct()
    return asked.withColumn("__key__", key).join(done, "__key__", "left_anti").drop("__key__")
