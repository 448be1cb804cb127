"""Analysis documents: sections with defaults, and the columns that a saved post takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import combined_text, empty_to_null, first_or_null, first_seen, known_and_unknown, truthy
from ..functions.media import orientation
from ..functions.numbers import engagement_rate, round_half_up
from ..functions.text import either

_NAMED = "array<struct<name:string>>"
#: What is read of an analysis document; sections that an answer lacks are null and get defaults.
DOCUMENT = (
    "platform string, content struct<summary:string,primary_category:string,secondary_categories:array<string>,topics:array<string>,keywords:array<string>>, "
    "creator struct<profile_url:string,verified:boolean>, caption_analysis struct<summary:string,keywords:array<string>,call_to_actions:array<string>>, "
    f"entities struct<brands:{_NAMED},products:{_NAMED},companies:{_NAMED},restaurants:{_NAMED},services:{_NAMED},people:{_NAMED},locations:{_NAMED},websites:{_NAMED}>, "
    "visual_analysis struct<brands_visible:array<string>,products_visible:array<string>,people_visible:array<string>,locations_visible:array<string>,objects_visible:array<string>,logos_visible:array<string>>, "
    "audio_analysis struct<artist:string,song_name:string,audio_id:string,uses_original_audio:boolean,transcript:string,spoken_information:array<string>>, "
    "promotion struct<is_promotional:boolean,is_sponsored:boolean,is_paid_partnership:boolean,promotion_type:string,promoted_entities:array<string>,offers:array<string>,discounts:array<string>,call_to_actions:array<string>>, "
    "audience struct<primary_audience:string,interests:array<string>,geographic_focus:array<string>,intent:string,confidence:double>, "
    "content_style struct<tone:array<string>,style:array<string>,format:string>, "
    "engagement struct<likes:bigint,comments:bigint,shares:bigint,saves:bigint,views:bigint,plays:bigint,reach:bigint,impressions:bigint,engagement_rate:double,engagement_rate_formula:string>, "
    "hashtags struct<all:array<string>,brand:array<string>,product:array<string>,industry:array<string>,location:array<string>,campaign:array<string>,topic:array<string>,generic:array<string>>, "
    "campaign_insights struct<relevant_industries:array<string>,relevant_brand_categories:array<string>,relevant_product_categories:array<string>,relevant_audiences:array<string>,relevant_locations:array<string>,"
    "potential_campaign_themes:array<string>,potential_collaboration_categories:array<string>,campaign_suitability:string,reasoning:string>, "
    "influencer_analysis struct<niche:string,sub_niches:array<string>,content_strengths:array<string>,potential_collaboration_types:array<string>,potential_brand_categories:array<string>>, "
    "data_quality struct<available_fields:array<string>,missing_fields:array<string>,unavailable_metrics:array<string>,media_analysis_available:boolean,ocr_available:boolean,transcript_available:boolean>, "
    "extracted_information array<string>"
)


def _filled(section: str, kinds: dict[str, str]) -> Column:
    """A section whose missing strings and arrays are empty; other kinds stay null."""
    empty = {"string": F.lit(""), "array": F.array().cast("array<string>"), "named": F.array().cast(_NAMED), "zero": F.lit(0.0)}
    return F.struct(*[F.coalesce(F.col(f"d.{section}.{k}"), empty[v]).alias(k) if v in empty else F.col(f"d.{section}.{k}").alias(k) for k, v in kinds.items()])


def sections(content: DataFrame, answer: str = "answer", transcript: str = "transcript", ocr_texts: str = "ocr_texts") -> DataFrame:
    """``content`` (canonical posts with an answer as JSON text, a transcript and OCR texts) with ``analysis``, all sixteen sections.

    An answer that isn't JSON counts as without sections.
    """
    rows = content.withColumn("d", F.from_json(answer, DOCUMENT))
    metric = lambda k: F.col(f"metrics.{k}")
    names = "brands products companies restaurants services people locations websites".split()
    visible = "brands_visible products_visible people_visible locations_visible objects_visible logos_visible".split()
    has_text = F.coalesce(F.size(ocr_texts) > 0, F.lit(False))
    has_words = F.coalesce(F.col(transcript) != "", F.lit(False))
    known, _ = known_and_unknown({k: k for k in ("caption", "hashtags", "mentions", "music_info", "video_duration", "published_at")})
    _, no_metric = known_and_unknown({k: f"metrics.{k}" for k in ("likes", "views", "plays", "comments", "shares", "saves")})
    dimensions = F.when(F.col("dimensions").isNotNull(), F.struct(F.col("dimensions.width").alias("width"), F.col("dimensions.height").alias("height"), orientation("dimensions.width", "dimensions.height").alias("orientation")))
    none = F.array().cast("array<string>")
    tag_groups = "brand product industry location campaign topic generic".split()
    insight = {k: "array" for k in "relevant_industries relevant_brand_categories relevant_product_categories relevant_audiences relevant_locations potential_campaign_themes potential_collaboration_categories".split()}
    analysis = F.struct(
        F.coalesce(either("d.platform"), F.col("platform")).alias("platform"),
        F.struct(
            "content_id", "content_type", F.coalesce("source_url", F.lit("")).alias("url"), either("video_url").alias("video_url"), either("display_url").alias("thumbnail_url"), "published_at",
            F.col("video_duration").alias("duration_seconds"), dimensions.alias("dimensions"),
            _filled("content", {"summary": "string", "primary_category": "string", "secondary_categories": "array", "topics": "array", "keywords": "array"}).alias("found"),
        ).alias("content"),
        F.struct(F.col("author_username").alias("username"), F.col("author_full_name").alias("full_name"), either("d.creator.profile_url").alias("profile_url"), F.when(F.col("d.creator.verified"), True).alias("verified")).alias("creator"),
        F.struct(F.col("caption").alias("original_caption"), "hashtags", "mentions", _filled("caption_analysis", {"summary": "string", "keywords": "array", "call_to_actions": "array"}).alias("found")).alias("caption_analysis"),
        _filled("entities", dict.fromkeys(names, "named")).alias("entities"),
        _filled("visual_analysis", dict.fromkeys(visible, "array")).alias("visual_analysis"),
        F.coalesce(
            F.col("d.audio_analysis"),
            F.struct(either("music_info.artist_name").alias("artist"), either("music_info.song_name").alias("song_name"), either("music_info.audio_id").alias("audio_id"), F.when(F.col("music_info.uses_original_audio"), True).alias("uses_original_audio"), either(transcript).alias("transcript"), none.alias("spoken_information")),
        ).alias("audio_analysis"),
        F.struct(
            "d.promotion.is_promotional", "d.promotion.is_sponsored", F.coalesce("d.promotion.is_paid_partnership", "paid_partnership").alias("is_paid_partnership"), either("d.promotion.promotion_type").alias("promotion_type"),
            _filled("promotion", dict.fromkeys(["promoted_entities", "offers", "discounts", "call_to_actions"], "array")).alias("found"),
        ).alias("promotion"),
        _filled("audience", {"primary_audience": "string", "interests": "array", "geographic_focus": "array", "intent": "string", "confidence": "zero"}).alias("audience"),
        _filled("content_style", {"tone": "array", "style": "array", "format": "string"}).alias("content_style"),
        F.coalesce(
            F.col("d.engagement"),
            F.struct(*[metric(k).alias(k) for k in ("likes", "comments", "shares", "saves", "views", "plays")], F.lit(None).cast("long").alias("reach"), F.lit(None).cast("long").alias("impressions"), F.lit(None).cast("double").alias("engagement_rate"), F.lit(None).cast("string").alias("engagement_rate_formula")),
        ).alias("engagement"),
        F.coalesce(F.col("d.hashtags"), F.struct(F.col("hashtags").alias("all"), *[none.alias(k) for k in tag_groups])).alias("hashtags"),
        _filled("campaign_insights", insight | {"campaign_suitability": "string", "reasoning": "string"}).alias("campaign_insights"),
        _filled("influencer_analysis", {"niche": "string", "sub_niches": "array", "content_strengths": "array", "potential_collaboration_types": "array", "potential_brand_categories": "array"}).alias("influencer_analysis"),
        F.coalesce(
            F.col("d.data_quality"),
            F.struct(known.alias("available_fields"), none.alias("missing_fields"), no_metric.alias("unavailable_metrics"), (has_text | has_words).alias("media_analysis_available"), has_text.alias("ocr_available"), has_words.alias("transcript_available")),
        ).alias("data_quality"),
        F.coalesce("d.extracted_information", none).alias("extracted_information"),
    )
    return rows.withColumn("analysis", analysis).drop("d")


def saved_post(content: DataFrame, place_ids: str = "place_ids", source_url: str = "source_url", user_id: str = "user_id", transcript: str = "transcript", ocr: str = "ocr_texts", vision: str = "vision_texts") -> DataFrame:
    """The row that is saved of an analysed post (``content`` with ``analysis``, place ids and texts)."""
    named = lambda k: F.transform(f"analysis.entities.{k}", lambda x: x["name"])
    return content.select(
        first_or_null(place_ids).alias("place_id"), either(user_id).alias("user_id"), "platform", "content_type", "content_id", "product_type", "short_code", either(source_url).alias("post_url"),
        "author_username", F.col("author_full_name").alias("owner_full_name"), "caption", "video_url", "display_url", "first_comment",
        round_half_up("metrics.likes", 0).alias("likes"), round_half_up("metrics.views", 0).alias("views"), round_half_up("metrics.comments", 0).alias("comments"), round_half_up("metrics.plays").alias("video_plays"),
        engagement_rate("metrics.likes", "metrics.comments", "metrics.views").alias("engagement_rate"),
        round_half_up("video_duration").alias("video_duration"), round_half_up("dimensions.width").alias("dimensions_width"), round_half_up("dimensions.height").alias("dimensions_height"),
        "hashtags", "mentions", empty_to_null("tagged_users").alias("tagged_users"), "music_info", F.col("paid_partnership").alias("is_paid_partnership"), F.col("analysis.promotion.is_promotional").alias("is_promotional"),
        empty_to_null(first_seen(named("brands"), F.col("analysis.visual_analysis.brands_visible"))).alias("mentioned_brands"),
        empty_to_null(truthy(named("locations"))).alias("mentioned_locations"),
        either("analysis.content.found.primary_category").alias("primary_category"), empty_to_null("analysis.content.found.secondary_categories").alias("secondary_categories"), either("analysis.content.found.summary").alias("content_summary"),
        either("analysis.influencer_analysis.niche").alias("niche"), either("analysis.audience.primary_audience").alias("target_audience"), empty_to_null("analysis.promotion.found.call_to_actions").alias("call_to_actions"),
        either(transcript).alias("whisper_transcript"), combined_text(vision, ocr).alias("ocr_combined_text"), F.to_json("analysis").alias("ai_analysis"),
        F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )
