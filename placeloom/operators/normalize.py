"""Raw posts of two sources into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import truthy
from ..functions.numbers import round_half_up
from ..functions.text import either, falsy_to_null
from ..schemas import MUSIC, TAGGED_USER

_NO_STRINGS = "array<string>"


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(either(c), F.lit(""))


def _strings(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NO_STRINGS))


def _metrics(**values: Column) -> Column:
    return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])


def instagram(raw: DataFrame) -> DataFrame:
    """Posts of the schema ``INSTAGRAM``. Likes of -1 are hidden, so unknown. A post without id and short code gets a null content id."""
    children = F.coalesce(F.size("childPosts") > 0, F.lit(False))
    carousel = F.coalesce(F.col("type") == "Sidecar", F.lit(False)) | children
    video = ~carousel & (F.coalesce(F.col("type") == "Video", F.lit(False)) | F.coalesce(F.col("videoUrl") != "", F.lit(False)))
    of_children = truthy(F.transform("childPosts", lambda p: either(p["displayUrl"], p["url"], p["videoUrl"])))
    images = F.when(children, of_children).when(F.size("images") > 0, F.col("images")).when(F.col("displayUrl") != "", F.array("displayUrl")).otherwise(F.array().cast(_NO_STRINGS))
    width, height = falsy_to_null("dimensionsWidth", "number"), falsy_to_null("dimensionsHeight", "number")
    return raw.select(
        F.lit("instagram").alias("platform"),
        F.when(video, "reel").otherwise("post").alias("content_type"),
        either("id", "shortCode").alias("content_id"),
        F.coalesce(either("ownerUsername"), F.lit("unknown")).alias("author_username"),
        _or_empty("ownerFullName").alias("author_full_name"),
        _or_empty("caption").alias("caption"),
        _or_empty("videoUrl").alias("video_url"),
        _or_empty("displayUrl").alias("display_url"),
        images.alias("images"),
        _or_empty("shortCode").alias("short_code"),
        _strings("hashtags").alias("hashtags"),
        _strings("mentions").alias("mentions"),
        F.coalesce(F.col("taggedUsers"), F.array().cast(f"array<{TAGGED_USER}>")).alias("tagged_users"),
        F.col("musicInfo").alias("music_info"),
        falsy_to_null("videoDuration", "number").alias("video_duration"),
        F.when(width.isNotNull() & height.isNotNull(), F.struct(width.alias("width"), height.alias("height"))).alias("dimensions"),
        F.coalesce(F.col("paidPartnership"), F.lit(False)).alias("paid_partnership"),
        either("productType").alias("product_type"),
        either("timestamp").alias("published_at"),
        _metrics(likes=F.when(F.col("likesCount") != -1, F.col("likesCount")), views=F.col("videoViewCount"), plays=F.col("videoPlayCount"), comments=F.col("commentsCount"), shares=F.lit(None), saves=F.lit(None)).alias("metrics"),
        either("firstComment").alias("first_comment"),
        either("url").alias("source_url"),
    )


def _is_array(v: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return falsy_to_null(F.try_variant_get(v, path, "string"))


def _elements(v: Column) -> Column:
    """A variant array as an array of variants."""
    return v.cast("array<variant>")


def _strings_or(v: str, *paths: str) -> Column:
    """Of each element the text itself, or the first of the paths."""
    plain = lambda x: F.when(F.startswith(F.to_json(x), F.lit('"')), _text(x, "$"))
    return truthy(F.transform(_elements(F.col(v)), lambda x: F.coalesce(plain(x), *[_text(x, p) for p in paths])))


def tiktok(raw: DataFrame) -> DataFrame:
    """Posts of the schema ``TIKTOK``. The images come from the first field that is there, even if it is empty."""
    nested = lambda v: F.try_variant_get(F.col(v), "$.images", "array<variant>")
    images = (
        F.when(_is_array("slideshowImageLinks"), _strings_or("slideshowImageLinks", "$.downloadLink", "$.tiktokLink"))
        .when(_is_array("imageUrls"), F.transform(_elements(F.col("imageUrls")), lambda x: F.try_variant_get(x, "$", "string")))
        .when(_is_array("images"), _strings_or("images", "$.url", "$.display_image.url_list[0]", "$.imageURL.urlList[0]"))
        .when(nested("image_post_info").isNotNull(), truthy(F.transform(nested("image_post_info"), lambda x: _text(x, "$.display_image.url_list[0]"))))
        .when(nested("imagePost").isNotNull(), truthy(F.transform(nested("imagePost"), lambda x: _text(x, "$.imageURL.urlList[0]"))))
        .otherwise(F.array().cast(_NO_STRINGS))
    )
    slideshow = F.coalesce(F.col("isSlideshow"), F.lit(False)) | (F.size("__images__") > 0) | F.coalesce(F.col("postType") == "slideshow", F.lit(False))
    music = F.struct(
        _or_empty("musicMeta.musicAuthor").alias("artist_name"), _or_empty("musicMeta.musicName").alias("song_name"), F.coalesce(F.col("musicMeta.musicOriginal"), F.lit(False)).alias("uses_original_audio"),
        F.lit(False).alias("should_mute_audio"), F.lit("").alias("should_mute_audio_reason"), _or_empty("musicMeta.musicId").alias("audio_id"),
    )
    seconds = falsy_to_null("createTime", "number")
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tags = F.when(_is_array("hashtags"), _strings_or("hashtags", "$.name", "$.title")).otherwise(F.array().cast(_NO_STRINGS))
    return raw.withColumn("__images__", images).select(
        F.lit("tiktok").alias("platform"),
        F.when(slideshow, "post").otherwise("video").alias("content_type"),
        either("id").alias("content_id"),
        F.coalesce(either("authorMeta.name"), F.lit("unknown")).alias("author_username"),
        _or_empty("authorMeta.nickName").alias("author_full_name"),
        _or_empty("text").alias("caption"),
        _or_empty("videoUrl").alias("video_url"),
        F.coalesce(either("videoMeta.originalCoverUrl", "videoMeta.dynamicCoverUrl"), F.lit("")).alias("display_url"),
        F.when(F.size("__images__") > 0, F.col("__images__")).alias("images"),
        _or_empty("id").alias("short_code"),
        tags.alias("hashtags"),
        _strings("mentions").alias("mentions"),
        F.array().cast(f"array<{TAGGED_USER}>").alias("tagged_users"),
        F.when(F.col("musicMeta").isNotNull(), music).cast(MUSIC).alias("music_info"),
        falsy_to_null("videoMeta.duration", "number").alias("video_duration"),
        F.when(F.col("videoMeta").isNotNull(), F.struct(F.col("videoMeta.width").alias("width"), F.col("videoMeta.height").alias("height"))).alias("dimensions"),
        (F.coalesce(F.col("isSponsored"), F.lit(False)) | F.coalesce(F.col("isAd"), F.lit(False))).alias("paid_partnership"),
        F.lit(None).cast("string").alias("product_type"),
        F.coalesce(either("createTimeISO"), iso).alias("published_at"),
        _metrics(likes=F.col("diggCount"), views=F.col("playCount"), plays=F.col("playCount"), comments=F.col("commentCount"), shares=F.col("shareCount"), saves=F.col("collectCount")).alias("metrics"),
        F.lit(None).cast("string").alias("first_comment"),
        either("webVideoUrl").alias("source_url"),
    )


def posts(instagram_raw: DataFrame, tiktok_raw: DataFrame) -> DataFrame:
    """Both sources in one table."""
    return instagram(instagram_raw).unionByName(tiktok(tiktok_raw))


def card(content: DataFrame) -> DataFrame:
    """The first columns of a crawled post, before any analysis."""
    return content.select(
        "content_id", "display_url", "video_url", "caption", "author_username", F.col("author_full_name").alias("owner_full_name"), "content_type", "platform", "published_at",
        round_half_up("metrics.likes", 0).alias("likes"), round_half_up("metrics.comments", 0).alias("comments"), F.lit("scraped").alias("status"),
    )
