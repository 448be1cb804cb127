"""Schemas of the stored tables, of raw posts and of the canonical post, with keys and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

_PRIMITIVES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "variant": T.VariantType(),
    "rate": T.DecimalType(8, 4),
}


def _table(text: str) -> T.StructType:
    """A schema from ``name:type`` words; ``*`` after the type is an array, ``!`` is not null, no type is string."""
    fields = []
    for word in text.split():
        name, _, kind = word.partition(":")
        nullable = not name.endswith("!") and not kind.endswith("!")
        kind = kind.rstrip("!") or "string"
        base = _PRIMITIVES[kind.rstrip("*")]
        fields.append(T.StructField(name.rstrip("!"), T.ArrayType(base) if kind.endswith("*") else base, nullable))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "profiles": _table("id! display_name phone created_at:timestamp"),
    "places": _table(
        "id! name! address neighborhood city category description creator_handle source latitude:double longitude:double source_url user_id audio_transcript social_post_id created_at:timestamp"
    ),
    "social_posts": _table(
        "id! place_id user_id platform! content_type content_id! author_username owner_full_name caption video_url display_url likes:int views:int comments:int created_at:timestamp "
        "raw_apify_data:variant ai_analysis:variant ocr_frames_apify:variant ocr_frames_gpt:variant whisper_transcript video_plays:int video_duration:int dimensions_width:int dimensions_height:int "
        "hashtags:string* mentions:string* tagged_users:variant music_info:variant mentioned_brands:string* mentioned_locations:string* primary_category secondary_categories:string* content_summary "
        "is_promotional:boolean is_paid_partnership:boolean short_code product_type engagement_rate:rate ocr_combined_text first_comment niche target_audience call_to_actions:string* post_url status error_message"
    ),
    "saved_places": _table("id! user_id! place_id! created_at:timestamp"),
    "lists": _table("id! user_id! title! description city cover_emoji is_public:boolean slug created_at:timestamp"),
    "list_places": _table("id! list_id! place_id! position:int created_at:timestamp"),
    "list_collaborators": _table("id! list_id! user_id! role created_at:timestamp"),
    "guides": _table("id! slug! title! is_published:boolean"),
    "guide_places": _table("id! guide_id! name position:int"),
    "follows": _table("id! follower_id! following_id! created_at:timestamp"),
    "waitlist": _table("id! email! name role created_at:timestamp"),
    "cities": _table("id! name! latitude:double longitude:double created_at:timestamp"),
    "audio_uploads": _table("id! social_post_id file_name storage_path public_url mime_type size_bytes:long"),
}

UNIQUE: dict[str, list[list[str]]] = {
    "profiles": [["id"]],
    "places": [["id"]],
    "social_posts": [["id"], ["platform", "content_id"]],
    "saved_places": [["id"], ["user_id", "place_id"]],
    "lists": [["id"]],
    "list_places": [["id"], ["list_id", "place_id"]],
    "list_collaborators": [["id"], ["list_id", "user_id"]],
    "guides": [["id"], ["slug"]],
    "guide_places": [["id"]],
    "follows": [["id"], ["follower_id", "following_id"]],
    "waitlist": [["id"], ["email"]],
    "cities": [["id"], ["name"]],
}

#: Values of columns that a row doesn't give.
DEFAULTS: dict[str, dict[str, object]] = {
    "places": {"city": "New York"},
    "social_posts": {"likes": 0, "views": 0, "comments": 0, "status": "pending"},
    "lists": {"is_public": True},
    "list_places": {"position": 0},
    "list_collaborators": {"role": "editor"},
    "guides": {"is_published": False},
    "waitlist": {"role": "explorer"},
}

#: What becomes of children when a parent goes: (child, its column, parent, action).
REFERENCES: list[tuple[str, str, str, str]] = [
    ("places", "social_post_id", "social_posts", "cascade"),
    ("social_posts", "place_id", "places", "set null"),
    ("saved_places", "place_id", "places", "cascade"),
    ("list_places", "list_id", "lists", "cascade"),
    ("list_places", "place_id", "places", "cascade"),
    ("list_collaborators", "list_id", "lists", "cascade"),
    ("guide_places", "guide_id", "guides", "cascade"),
    ("profiles", "id", "users", "cascade"),
    ("places", "user_id", "users", "set null"),
    ("social_posts", "user_id", "users", "set null"),
    ("saved_places", "user_id", "users", "cascade"),
    ("lists", "user_id", "users", "cascade"),
    ("list_collaborators", "user_id", "users", "cascade"),
    ("follows", "follower_id", "users", "cascade"),
    ("follows", "following_id", "users", "cascade"),
]

TAGGED_USER = "struct<full_name:string,id:string,is_verified:boolean,profile_pic_url:string,username:string>"
MUSIC = "struct<artist_name:string,song_name:string,uses_original_audio:boolean,should_mute_audio:boolean,should_mute_audio_reason:string,audio_id:string>"
INSTAGRAM = (
    "id string, type string, shortCode string, caption string, url string, displayUrl string, videoUrl string, ownerId string, ownerUsername string, ownerFullName string, productType string, timestamp string, firstComment string, "
    "hashtags array<string>, mentions array<string>, images array<string>, likesCount bigint, commentsCount bigint, videoViewCount bigint, videoPlayCount bigint, videoDuration double, dimensionsWidth int, dimensionsHeight int, "
    f"paidPartnership boolean, taggedUsers array<{TAGGED_USER}>, musicInfo {MUSIC}, childPosts array<struct<displayUrl:string,url:string,videoUrl:string>>"
)
TIKTOK = (
    "id string, text string, videoUrl string, webVideoUrl string, createTimeISO string, createTime bigint, diggCount bigint, playCount bigint, commentCount bigint, shareCount bigint, collectCount bigint, "
    "videoMeta struct<duration:double,width:int,height:int,originalCoverUrl:string,dynamicCoverUrl:string>, authorMeta struct<id:string,name:string,nickName:string>, "
    "musicMeta struct<musicAuthor:string,musicName:string,musicOriginal:boolean,musicId:string>, hashtags variant, mentions array<string>, isAd boolean, isSponsored boolean, "
    "isSlideshow boolean, postType string, slideshowImageLinks variant, imageUrls variant, images variant, image_post_info variant, imagePost variant"
)
OCR_FRAME = "frame_index int, timestamp double, texts array<string>, confidence double"
VISION_FRAME = f"{OCR_FRAME}, brands array<string>, locations array<string>, prices array<string>, cta array<string>, description string"
CRAWL_EVENT = "run_id string, status string, dataset_id string, post_id string, event_time timestamp"
STATUS_EVENT = "post_id string, status string, error_message string, event_time timestamp"
