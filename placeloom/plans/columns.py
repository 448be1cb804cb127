"""Queries of column functions: each applies several to every row of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, media, numbers, text, urls
from .analogues import read
from .register import query


def _joined(c: Column) -> Column:
    return F.array_join(c, "|", "null")


@query(
    """SELECT p_partkey AS id, translate('₹' || p_type, 'Oo', '00') AS price, p_type AS no_price, string_split(p_name || '.' || p_brand, '.')[-1] AS extension,
'Original Transcript:' || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || chr(10) || chr(10) || 'English Translation:' || chr(10) || p_type AS transcript,
'@' || replace(p_name, ' ', '_') AS handle, CASE p_size % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Los Angeles' END AS handle_city,
array_to_string(list_transform(string_split(p_name || CASE WHEN p_size % 4 = 3 THEN ' inn' ELSE '' END, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS handle_name,
replace(p_name, ' ', '%20') || '%2F%26%20' AS encoded, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 1 THEN p_type END) AS fallback
FROM part"""
)
def text_columns(spark: SparkSession, d: str) -> DataFrame:
    p, size = read(spark, d, "part"), F.col("p_size")
    bare = F.replace("p_name", F.lit(" "), F.lit("_"))
    suffix = F.when(size % 4 == 0, "nyc").when(size % 4 == 1, "BLR").when(size % 4 == 2, "la").otherwise("inn")
    venue = F.concat(F.lit("@"), bare, F.lit("_"), suffix)
    return p.select(
        F.col("p_partkey").alias("id"), text.fix_price(F.concat(F.lit("₹"), "p_type")).alias("price"), text.fix_price("p_type").alias("no_price"), text.file_extension(F.concat("p_name", F.lit("."), "p_brand")).alias("extension"),
        text.transcript(F.when(size % 2 == 0, F.col("p_name")), "p_type").alias("transcript"), text.handle(F.concat(F.lit(" @@"), bare)).alias("handle"), text.handle_city(venue).alias("handle_city"), text.handle_name(venue).alias("handle_name"),
        urls.uri_encode(F.concat("p_name", F.lit("/& "))).alias("encoded"), text.either(F.when(size % 3 == 0, F.col("p_brand")).otherwise(""), F.when(size % 3 == 1, F.col("p_type"))).alias("fallback"),
    )


@query(
    """SELECT o_orderkey AS id, CAST(floor(o_totalprice - 250000.5 + 0.5) AS BIGINT) AS rounded, CAST(coalesce(floor(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END + 0.5), -1) AS BIGINT) AS rounded_or,
CAST(greatest(1, least(100, o_orderkey % 300 - 20)) AS BIGINT) AS clamped, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 * 86400000000 END AS published_at,
(o_orderkey % 101) / 100.0 AS share, CAST(floor((o_orderkey % 101) / 100.0 * 100 + 0.5) AS BIGINT) || '%' AS percent, format('{:,}', o_orderkey * 1234) AS thousands, CAST(ceil(o_custkey / 7.0) AS BIGINT) AS pages
FROM orders"""
)
def number_columns(spark: SparkSession, d: str) -> DataFrame:
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    iso = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("no time")
    share = numbers.confidence_share(key % 101)
    return o.select(
        key.alias("id"), numbers.round_half_up(F.col("o_totalprice") - 250000.5).alias("rounded"), numbers.round_half_up(F.when(key % 5 > 0, F.col("o_totalprice")), -1).alias("rounded_or"),
        numbers.clamp(key % 300 - 20, 1, 100).cast("long").alias("clamped"), F.unix_micros(numbers.published_at(iso, key % 7 * 86400)).alias("published_at"),
        share.alias("share"), numbers.percent_text(share).alias("percent"), numbers.number_text(key * 1234).alias("thousands"), numbers.total_pages("o_custkey", 7).alias("pages"),
    )


@query(
    """SELECT doc_id, doc_id % 4 < 2 AND n_chars <= 3000 OR doc_id % 4 = 2 AND n_chars <= 3000 AS may_upload, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN n_chars > 1000 THEN 'vertical' ELSE 'horizontal' END AS orientation,
CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 1000 AS INTEGER) END AS frame, least((doc_id % 1000 - 1) * 0.5, n_chars / 100.0) AS seconds, CAST(coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, 60) AS DOUBLE) AS duration FROM documents"""
)
def media_columns(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: kinds by their numbers, bytes and sizes by their characters."""
    docs, key, n = read(spark, d, "documents"), F.col("doc_id"), F.col("n_chars")
    mime = F.when(key % 4 == 0, "audio/ogg").when(key % 4 == 1, "audio/x-wav").otherwise("text/plain")
    name = F.when(key % 4 == 2, "voice.MP3").otherwise("notes.txt")
    width = F.when(key % 5 > 0, F.lit(1000))
    file = F.concat(F.lit("/tmp/frame_"), (key % 1000).cast("string"), F.when(key % 3 > 0, ".jpg").otherwise(".png"))
    return docs.select(
        "doc_id", media.may_upload(mime, name, n / 3000 * media.MOST_UPLOAD_BYTES).alias("may_upload"), media.orientation(width, n).alias("orientation"),
        media.frame_number(file).alias("frame"), media.frame_time(key % 1000, n / 100.0, 0.5).alias("seconds"), media.known_duration(F.when(key % 2 == 0, n)).cast("double").alias("duration"),
    )


@query(
    """WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS a, p_name, p_type, p_brand, p_size FROM part)
SELECT id, array_to_string(list_concat(a, [p_type]), '|') AS truthy, array_to_string([p_name, p_brand], '|') AS cleaned, CASE WHEN a[1] = a[2] THEN a[1] || '|' ELSE a[1] || '|' || a[2] || '|' END || p_type AS first_seen,
CASE WHEN p_size % 2 = 0 THEN array_to_string(a, '|') END AS not_empty, a[1] AS first, CASE WHEN p_brand LIKE 'Brand#1%' THEN p_type END AS by_prefix, CASE WHEN list_contains(a, 'ring') OR list_contains(a, 'red') THEN p_type END AS by_member,
CASE WHEN p_size % 2 = 0 THEN 'name|size' ELSE 'size' END AS known, CASE WHEN p_size % 2 = 0 THEN 'price' ELSE 'name|price' END AS unknown FROM w"""
)
def array_columns(spark: SparkSession, d: str) -> DataFrame:
    p, size, none = read(spark, d, "part"), F.col("p_size"), F.lit(None).cast("string")
    words = F.split("p_name", " ")
    told = F.array(F.struct(F.lit("other").alias("k"), F.array(F.lit("none")).alias("m"), F.lit("not this").alias("v")), F.struct(F.col("p_brand").alias("k"), words.alias("m"), F.col("p_type").alias("v")))
    known, unknown = arrays.known_and_unknown({"name": F.when(size % 2 == 0, F.col("p_name")), "size": size, "price": none})
    return p.select(
        F.col("p_partkey").alias("id"), _joined(arrays.truthy(F.concat(words, F.array(F.lit(""), none, "p_type")))).alias("truthy"), _joined(arrays.clean_array(F.array(F.concat(F.lit(" \t"), "p_name", F.lit(" ")), F.lit("  "), none, "p_brand"))).alias("cleaned"),
        _joined(arrays.first_seen(words, F.lit(None).cast("array<string>"), F.array(F.lit(""), "p_type"), words)).alias("first_seen"), _joined(arrays.empty_to_null(F.when(size % 2 == 0, words).otherwise(F.array().cast("array<string>")))).alias("not_empty"),
        arrays.first_or_null(words).alias("first"), arrays.find_by_prefix(told, "k", ["Brand#1", "Mark#"], "v").alias("by_prefix"), arrays.find_by_member(told, "m", ["ring", "red"], "v").alias("by_member"), _joined(known).alias("known"), _joined(unknown).alias("unknown"),
    )


@query("SELECT n_regionkey, count(*) AS nations, sum(n_nationkey) FILTER (n_name LIKE '%1%') AS ones, min(n_nationkey) AS first FROM nation GROUP BY n_regionkey")
def map_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as a map from names to keys."""
    by = read(spark, d, "nation").groupBy("n_regionkey").agg(arrays.to_map("n_name", "n_nationkey").alias("m"))
    ones = F.map_values(F.map_filter("m", lambda k, v: F.contains(k, F.lit("1"))))
    total = F.when(F.size(ones) > 0, F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s + x))
    return by.select("n_regionkey", F.size("m").cast("long").alias("nations"), total.alias("ones"), F.array_min(F.map_values("m")).alias("first"))


@query(
    r"""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'https://www.instagram.com/p/' || page_id ELSE url END AS cleaned, CASE WHEN page_id % 3 < 2 THEN 'instagram' END AS platform,
'https://instagram.com/reel/' || page_id AS key, 'https://instagram.com/reels/' || page_id || '|https://instagram.com/reels/' || page_id || '/|https://instagram.com/reel/' || page_id || '|https://instagram.com/reel/' || page_id || '/' AS variants FROM pages"""
)
def post_urls(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of post addresses made of page numbers."""
    key = F.col("page_id")
    number = key.cast("string")
    spelt = F.when(key % 3 == 0, F.concat(F.lit(" Instagram.com/p/"), number, F.lit("//?x=1"))).when(key % 3 == 1, F.concat(F.lit("http://m.instagram.com/p/"), number, F.lit("/#top"))).otherwise(F.col("url"))
    reels = F.concat(F.lit("https://instagram.com/reels/"), number, F.lit("/?igsh=1"))
    return read(spark, d, "pages").select("page_id", urls.instagram_url(spelt).alias("cleaned"), urls.strict_platform(F.lower(spelt)).alias("platform"), urls.post_key(reels).alias("key"), _joined(urls.url_variants(reels)).alias("variants"))
