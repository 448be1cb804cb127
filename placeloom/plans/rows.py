"""Queries of operators on whole tables: visibility, changes, posts of two sources, places, frames and the status of posts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, enrich, frames, mutate, normalize, paging, policy, posts
from ..schemas import INSTAGRAM, TIKTOK
from ..sources import tables as sources
from ..streaming import status as states
from . import analogues as a
from .analogues import read
from .register import query

# Visibility


def _people(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers as users with profiles and follows, orders as their posts and guides, suppliers as cities."""
    c, o, li = read(spark, d, "customer"), read(spark, d, "orders"), read(spark, d, "lineitem")
    return a.sharing(spark, d) | {
        "profiles": a.profiles(spark, d),
        "cities": read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "social_posts": o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("user_id"), F.col("o_orderpriority").alias("caption")),
        "places": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name")),
        "saved_places": a.saved(spark, d),
        "guide_places": li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("guide_id"), F.col("l_partkey").alias("place_id"), F.col("l_linenumber").alias("position")),
        "follows": c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("follower_id"), F.col("c_nationkey").cast("long").alias("following_id")),
        "waitlist": c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@example.org")).alias("email")),
    }


@query(
    """SELECT 'cities' AS part, count(*) AS seen FROM supplier UNION ALL SELECT 'profiles', count(*) FROM customer UNION ALL SELECT 'places', count(*) FROM orders
UNION ALL SELECT 'social_posts', count(*) FROM orders UNION ALL SELECT 'follows', count(*) FROM customer UNION ALL SELECT 'waitlist', 0 UNION ALL SELECT 'saved_places', 0"""
)
def rls_public_tables(spark: SparkSession, d: str) -> DataFrame:
    """What someone without a name may see."""
    tables, out = _people(spark, d), None
    for name in ("cities", "profiles", "places", "social_posts", "follows", "waitlist", "saved_places"):
        part = policy.visible(name, tables).agg(F.lit(name).alias("part"), F.count("*").alias("seen"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT place_id, epoch_us(created_at) AS created_at FROM ({a.SAVED_SQL}) WHERE user_id = 17")
def rls_saved_places(spark: SparkSession, d: str) -> DataFrame:
    return policy.visible("saved_places", _people(spark, d), 17).select("place_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at"))


@query("SELECT l_orderkey AS guide_id, l_partkey AS place_id, l_linenumber AS position FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def rls_guide_places(spark: SparkSession, d: str) -> DataFrame:
    return policy.visible("guide_places", _people(spark, d), None).select("guide_id", "place_id", "position")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 > 0 AND o_custkey = 17")
def rls_posts_update(spark: SparkSession, d: str) -> DataFrame:
    tables = _people(spark, d)
    return policy.may_write("social_posts", "update", tables["social_posts"], tables, 17).select("id")


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS following_id FROM customer WHERE c_custkey % 40 = 17")
def rls_follows_write(spark: SparkSession, d: str) -> DataFrame:
    tables = _people(spark, d)
    return policy.may_write("follows", "insert", tables["follows"], tables, 17).select("id", "following_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS display_name FROM customer WHERE c_custkey = 17")
def rls_profiles_write(spark: SparkSession, d: str) -> DataFrame:
    tables = _people(spark, d)
    return policy.may_write("profiles", "update", tables["profiles"], tables, 17).select("id", "display_name")


@query("SELECT c_custkey AS id, c_name || '@example.org' AS email FROM customer")
def rls_waitlist_admin(spark: SparkSession, d: str) -> DataFrame:
    return policy.visible("waitlist", _people(spark, d), 1, "an.admin@example.org")


@query("SELECT l_orderkey AS list_id, l_suppkey AS user_id, CASE WHEN l_returnflag = 'R' THEN 'editor' ELSE 'viewer' END AS role FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 17) GROUP BY ALL")
def rls_collaborators_write(spark: SparkSession, d: str) -> DataFrame:
    tables = _people(spark, d)
    return policy.may_write("list_collaborators", "insert", tables["list_collaborators"], tables, 17)


@query("SELECT count(*) FILTER (who = 'known') AS known, count(*) FILTER (who = 'nobody') AS nobody FROM (SELECT 'known' AS who FROM orders UNION ALL SELECT 'known' FROM supplier)")
def rls_inserts_of_users(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a user, and that nobody, may add to places and cities."""
    tables, counts = _people(spark, d), []
    for who, uid in (("known", 17), ("nobody", None)):
        counts += [policy.may_write(t, "insert", tables[t], tables, uid).select(F.lit(who).alias("who")) for t in ("places", "cities")]
    both = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return both.agg(F.count_if(F.col("who") == "known").alias("known"), F.count_if(F.col("who") == "nobody").alias("nobody"))


# Changes


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_mktsegment END ELSE c_name END AS display_name, c_mktsegment AS phone FROM customer")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Every third name changes, half of these to null."""
    c = read(spark, d, "customer")
    target = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("phone"))
    return mutate.update(target, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_mktsegment")).alias("display_name")), ["id"])


@query("SELECT c_custkey * 2 AS id FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def unmatched_patches(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return mutate.unmatched(c, c.select((F.col("id") * 2).alias("id")), "id")


@query(
    """WITH p AS (SELECT o_orderkey AS id, 'instagram' AS platform, CASE WHEN o_orderkey % 4 = 0 THEN 'pending_' || o_orderkey ELSE 'c' || o_orderkey END AS content_id, CASE WHEN o_orderkey % 4 = 0 THEN 'scraping' ELSE 'completed' END AS status, o_orderpriority AS caption FROM orders),
n AS (SELECT count(*) AS n FROM orders), s AS (SELECT o_orderkey AS id, 'c' || (o_orderkey + 1) AS content_id, 'saved ' || o_orderstatus AS caption, o_orderkey + 1 < n AS known FROM orders, n WHERE o_orderkey % 4 = 0)
SELECT p.id, CASE WHEN s.id IS NOT NULL AND NOT s.known THEN s.content_id ELSE p.content_id END AS content_id, CASE WHEN s.id IS NOT NULL OR k.id IS NOT NULL THEN 'completed' ELSE p.status END AS status,
CASE WHEN k.id IS NOT NULL THEN k.caption WHEN s.id IS NOT NULL AND NOT s.known THEN s.caption ELSE p.caption END AS caption
FROM p LEFT JOIN s ON p.id = s.id LEFT JOIN s k ON k.known AND k.content_id = p.content_id"""
)
def merge_duplicate_posts(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth order is a placeholder that turns out to be the order after it, or (the last) a new one."""
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    text = key.cast("string")
    pending = key % 4 == 0
    base = o.select(
        key.alias("id"), F.lit("instagram").alias("platform"), F.when(pending, F.concat(F.lit("pending_"), text)).otherwise(F.concat(F.lit("c"), text)).alias("content_id"),
        F.when(pending, "scraping").otherwise("completed").alias("status"), F.col("o_orderpriority").alias("caption"),
    )
    saved = o.where("o_orderkey % 4 = 0").select(key.alias("id"), F.lit("instagram").alias("platform"), F.concat(F.lit("c"), (key + 1).cast("string")).alias("content_id"), F.concat(F.lit("saved "), "o_orderstatus").alias("caption"))
    return mutate.merge_duplicate(base, saved, ["caption"]).select("id", "content_id", "status", "caption")


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1000 ELSE o_custkey END AS parent FROM orders JOIN customer ON o_custkey = c_custkey")
def attach_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders of every fifth customer get another parent."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_custkey").alias("parent"))
    links = read(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("owner"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"))
    return mutate.attach(o, links, "owner", "parent").select("id", "parent")


@query(
    """WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), lists AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (FROM gone))
SELECT 'profiles' AS part, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone)
UNION ALL SELECT 'lists', count(*) FROM orders WHERE o_orderkey NOT IN (FROM lists)
UNION ALL SELECT 'list_places', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (FROM lists))
UNION ALL SELECT 'list_collaborators', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag = 'R' FROM lineitem WHERE l_orderkey NOT IN (FROM lists) AND l_suppkey NOT IN (FROM gone))
UNION ALL SELECT 'saved_places', count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (FROM gone))
UNION ALL SELECT 'follows', count(*) FROM customer WHERE c_custkey % 40 NOT IN (FROM gone) AND c_nationkey NOT IN (FROM gone)
UNION ALL SELECT 'places', count(*) FROM orders UNION ALL SELECT 'places without user', count(*) FROM orders WHERE o_custkey IN (FROM gone)"""
)
def cascade_delete_user(spark: SparkSession, d: str) -> DataFrame:
    """Users in debt go: what is theirs goes along, by each way that leads to it, and places lose their user."""
    names = ["profiles", "lists", "list_places", "list_collaborators", "saved_places", "follows", "places"]
    tables = {k: v for k, v in _people(spark, d).items() if k in names}
    tables = {k: (v if "id" in v.columns else v.withColumn("id", F.xxhash64(*v.columns))) for k, v in tables.items()}
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    left = mutate.delete_cascading(tables, "users", gone)
    out = left["places"].where("user_id is null").agg(F.lit("places without user").alias("part"), F.count("*").alias("n"))
    for name in names:
        out = out.unionByName(left[name].agg(F.lit(name).alias("part"), F.count("*").alias("n")))
    return out


@query("SELECT 'not null(name)' AS rule, count(*) AS broken FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'not null(id)', 0 UNION ALL SELECT 'unique(id)', 0")
def table_violations(spark: SparkSession, d: str) -> DataFrame:
    """Parts as places, of which every tenth has no name."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("name"))
    out = None
    for rule, bad in mutate.violations("places", p).items():
        part = bad.agg(F.lit(rule).alias("rule"), F.count("*").alias("broken"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_custkey AS user_id, o_orderpriority AS title, true AS is_public FROM orders")
def insert_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    """New lists get ids, times and defaults; all ids differ."""
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"))
    made = sources.with_new_ids(mutate.with_defaults(rows, "lists"))
    return made.where("length(id) = 36 and created_at is not null").select("user_id", "title", "is_public")


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    found = [paging.lookup(o, "id", 7, exactly=True), paging.lookup(o, "id", -1)]
    return spark.createDataFrame([tuple(r) for r in found if r is not None], o.schema)


@query("SELECT o_orderkey AS id, o_orderdate IS NOT NULL AS dated FROM orders WHERE 'https://x.example/' || o_orderkey % 300 NOT IN (SELECT 'https://x.example/' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def uncached_urls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as asked addresses, suppliers in credit as completed posts."""
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").isNotNull().alias("dated"), F.concat(F.lit("https://x.example/"), (F.col("o_orderkey") % 300).cast("string")).alias("url"))
    done = read(spark, d, "supplier").select(F.concat(F.lit("https://x.example/"), F.col("s_suppkey").cast("string")).alias("post_url"), F.when(F.col("s_acctbal") > 0, "completed").otherwise("failed").alias("status"))
    return posts.uncached(asked, done, F.col("url"), F.col("post_url")).select("id", "dated")


@query("SELECT o_orderkey AS id, c_name AS place, c_acctbal > 0 AS cached FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    done = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("place"))
    return states.cached_answers(asked, done, "key").select("id", "place", F.when(F.col("cached"), True).alias("cached"))


# Posts of two sources


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'post' WHEN o_orderkey % 5 IN (1, 2) THEN 'reel' ELSE 'post' END AS content_type, CASE WHEN o_orderkey % 11 > 0 THEN 'i' || o_orderkey ELSE 's' || o_orderkey END AS content_id,
CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderstatus END AS author_username, o_orderpriority AS caption, CASE o_orderkey % 5 WHEN 0 THEN 'd1|u2' WHEN 3 THEN 'x' WHEN 4 THEN 'pic' ELSE 'pic' END AS images,
CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS likes, o_orderkey % 13 AS views, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) END AS video_duration, CASE WHEN o_orderkey % 2 = 1 THEN 9 END AS width, o_orderkey % 6 = 0 AS paid_partnership FROM orders"""
)
def instagram_posts(spark: SparkSession, d: str) -> DataFrame:
    return post_columns(_instagram(spark, d))


def post_columns(posts: DataFrame) -> DataFrame:
    return posts.select(
        F.col("source_url").cast("long").alias("id"), "content_type", "content_id", "author_username", "caption", F.array_join("images", "|").alias("images"), F.col("metrics.likes").alias("likes"), F.col("metrics.views").alias("views"),
        "video_duration", F.col("dimensions.width").alias("width"), "paid_partnership",
    )


def _instagram(spark: SparkSession, d: str) -> DataFrame:
    return normalize.instagram(instagram_documents(spark, d).select(F.from_json("doc", INSTAGRAM).alias("d")).select("d.*"))


def instagram_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw posts of one source: carousels, reels, pictures, hidden likes and missing fields, by their numbers."""
    key = F.col("o_orderkey")
    number = key.cast("string")
    kind = key % 5
    return read(spark, d, "orders").select(
        F.to_json(F.struct(
            F.when(key % 11 > 0, F.concat(F.lit("i"), number)).otherwise("").alias("id"), F.concat(F.lit("s"), number).alias("shortCode"), F.when(kind == 0, "Sidecar").when(kind == 1, "Video").otherwise("Image").alias("type"),
            F.when(kind.isin(1, 2), "v").when(kind == 0, "v").alias("videoUrl"), F.lit("pic").alias("displayUrl"), F.when(kind == 3, F.array(F.lit("x"))).alias("images"),
            F.when(kind == 0, F.array(F.struct(F.lit("d1").alias("displayUrl"), F.lit("u1").alias("url")), F.struct(F.lit("").alias("displayUrl"), F.lit("u2").alias("url")))).alias("childPosts"),
            F.when(key % 3 > 0, F.col("o_orderstatus")).alias("ownerUsername"), F.col("o_orderpriority").alias("caption"), F.when(key % 7 > 0, key % 7).otherwise(-1).alias("likesCount"), (key % 13).alias("videoViewCount"), F.lit(5).alias("commentsCount"),
            (key % 4).cast("double").alias("videoDuration"), (key % 2 * 9).alias("dimensionsWidth"), F.lit(16).alias("dimensionsHeight"), F.when(key % 6 == 0, True).alias("paidPartnership"), number.alias("url"),
        )).alias("doc")
    )


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN 'i' || o_orderkey ELSE 's' || o_orderkey END AS content_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 ELSE 0 END AS likes, CAST(5 AS BIGINT) AS comments, 'scraped' AS status FROM orders"""
)
def post_cards(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a crawled post before any analysis."""
    content = _instagram(spark, d)
    return normalize.card(content).join(content.select("content_id", F.col("source_url").cast("long").alias("id")), "content_id").select("id", "content_id", "likes", "comments", "status")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS told FROM orders)
SELECT id, CASE WHEN told THEN 'S ' || id END AS content_summary, CASE WHEN told THEN 'food' END AS primary_category, CASE WHEN told THEN 'A|B|C' END AS mentioned_brands, CASE WHEN told THEN true END AS is_promotional,
CAST(CASE WHEN id % 7 > 0 AND id % 13 > 0 THEN round((id % 7 + 5) / (id % 13) * 100, 4) END AS DOUBLE) AS engagement_rate, CASE WHEN id % 2 = 0 THEN 'p' || id END AS place_id, 'v1 o1' AS ocr_combined_text,
CASE WHEN id % 2 = 1 THEN 'vertical' END AS orientation, CAST(16 AS BIGINT) AS n_sections, id % 7 = 0 AS likes_unavailable, id % 5 = 0 AS transcribed FROM o"""
)
def analysed_posts(spark: SparkSession, d: str) -> DataFrame:
    """Analysis documents with all sections, from answers that are whole, empty or no JSON, and the rows that are saved of them."""
    key = F.col("source_url").cast("long")
    told = F.format_string('{"content":{"summary":"S %d","primary_category":"food"},"entities":{"brands":[{"name":"A"},{"name":"B"}]},"visual_analysis":{"brands_visible":["B","C"]},"promotion":{"is_promotional":true}}', key)
    content = _instagram(spark, d).withColumn("answer", F.when(key % 3 == 0, told).when(key % 3 == 1, "no json").otherwise("{}"))
    content = content.withColumn("transcript", F.when(key % 5 == 0, "said").otherwise("")).withColumn("ocr_texts", F.array(F.lit("o1"), F.lit("v1"))).withColumn("vision_texts", F.array(F.lit("v1"), F.lit("")))
    done = analysis.sections(content).withColumn("place_ids", F.when(key % 2 == 0, F.array(F.concat(F.lit("p"), key.cast("string")))).otherwise(F.array().cast("array<string>"))).withColumn("user_id", F.lit(""))
    saved = analysis.saved_post(done).select(
        "content_id", "content_summary", "primary_category", F.array_join("mentioned_brands", "|").alias("mentioned_brands"), "is_promotional", F.col("engagement_rate").cast("double").alias("engagement_rate"), "place_id", "ocr_combined_text",
    )
    quality = "analysis.data_quality"
    facts = done.select(
        "content_id", key.alias("id"), F.col("analysis.content.dimensions.orientation").alias("orientation"), F.lit(len(done.schema["analysis"].dataType.fieldNames())).cast("long").alias("n_sections"),
        F.array_contains(f"{quality}.unavailable_metrics", "likes").alias("likes_unavailable"), F.col(f"{quality}.transcript_available").alias("transcribed"),
    )
    return facts.join(saved, "content_id").drop("content_id")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 9 = 0 THEN 'post' ELSE 'video' END AS content_type, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderstatus END AS author_username, o_orderpriority AS caption,
CASE o_orderkey % 4 WHEN 0 THEN 't|s' WHEN 1 THEN 'a|b' END AS images, 'one|two|three' AS hashtags, CASE WHEN o_orderkey % 5 > 0 THEN strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS published_at,
o_orderkey % 17 AS likes, o_orderkey % 6 = 0 AS paid_partnership, CASE WHEN o_orderkey % 2 = 0 THEN 'song ' || o_orderstatus END AS song FROM orders"""
)
def tiktok_posts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw posts of the other source: slideshows in several spellings, videos, times as epochs."""
    key = F.col("o_orderkey")
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    fields = F.concat_ws(
        ",", F.concat(F.lit('"id":"'), key.cast("string"), F.lit('"')), F.concat(F.lit('"text":'), quoted(F.col("o_orderpriority"))), F.when(key % 3 > 0, F.concat(F.lit('"authorMeta":{"name":"'), "o_orderstatus", F.lit('"}'))),
        F.when(key % 4 == 0, F.lit('"slideshowImageLinks":[{"downloadLink":"","tiktokLink":"t"},"s"]')).when(key % 4 == 1, F.lit('"imageUrls":["a","b"]')), F.when(key % 9 == 0, F.lit('"postType":"slideshow"')),
        F.lit('"hashtags":[{"name":"one"},{"title":"two"},"three"]'), F.when(key % 5 > 0, F.concat(F.lit('"createTime":'), key.cast("string"))), F.concat(F.lit('"diggCount":'), (key % 17).cast("string")),
        F.when(key % 6 == 0, F.lit('"isAd":true')), F.when(key % 2 == 0, F.concat(F.lit('"musicMeta":{"musicName":"song '), "o_orderstatus", F.lit('"}'))),
    )
    raw = read(spark, d, "orders").select(F.from_json(F.concat(F.lit("{"), fields, F.lit("}")), TIKTOK).alias("d")).select("d.*")
    return normalize.tiktok(raw).select(
        F.col("content_id").cast("long").alias("id"), "content_type", "author_username", "caption", F.array_join("images", "|").alias("images"), F.array_join("hashtags", "|").alias("hashtags"), "published_at",
        F.col("metrics.likes").alias("likes"), "paid_partnership", F.col("music_info.song_name").alias("song"),
    )


# Places, services and frames


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 26 = 25 THEN '' ELSE 'hood ' || c_custkey % 26 END AS found_neighborhood FROM customer"""
)
def reverse_geocode(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand near one of the nations, each a place; some have no position."""
    at = F.col("c_custkey") % 26
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(at < 25, at + 1.001).otherwise(0.0).alias("latitude"), F.when(at < 25, 10.001).otherwise(0.0).alias("longitude"))
    hoods = read(spark, d, "nation").select((F.col("n_nationkey") + 1.0).alias("latitude"), F.lit(10.0).alias("longitude"), F.concat(F.lit("hood "), F.col("n_nationkey").cast("string")).alias("neighborhood"))
    return enrich.reverse_geocode(c, hoods.unionByName(hoods.withColumn("latitude", F.col("latitude") + 0.005).withColumn("neighborhood", F.concat(F.lit("far "), "neighborhood")))).select("id", "found_neighborhood")


@query(
    """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'found ' || p_type END AS address, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS city, CASE WHEN p_size % 5 = 0 THEN 'Restaurants' ELSE p_brand END AS category,
'' AS description, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS latitude FROM part"""
)
def saved_place(spark: SparkSession, d: str) -> DataFrame:
    """What was given goes before what was found, and missing texts have defaults."""
    p, size, none = read(spark, d, "part"), F.col("p_size"), F.lit(None).cast("string")
    rows = p.select(
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.when(size % 2 == 0, F.col("p_brand")).otherwise("").alias("address"), F.when(size % 3 != 0, F.col("p_type")).alias("city"), none.alias("neighborhood"), F.when(size % 5 != 0, F.col("p_brand")).alias("category"),
        none.alias("description"), F.col("p_partkey").cast("string").alias("creator_handle"), F.concat(F.lit("found "), "p_type").alias("found_address"), none.alias("found_neighborhood"), F.when(size % 7 > 0, F.col("p_retailprice")).alias("found_latitude"), F.lit(0.0).alias("found_longitude"),
    )
    return enrich.saved_place(rows).select(F.col("creator_handle").cast("long").alias("id"), "name", "address", "city", "category", "description", "latitude")


@query(
    """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Cafe Nero' ELSE 'Bar Lux' END AS name, CASE p_size % 3 WHEN 0 THEN 'London' ELSE 'New York' END AS city, 'Neapolitan Pizzeria' AS category, '@author' AS creator_handle, 0.5 AS confidence FROM part WHERE p_size % 3 < 2"""
)
def places_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """Venue handles with a city become places; others don't."""
    size = F.col("p_size") % 3
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(size == 0, F.array(F.lit("@cafe.nero_london"), F.lit("@someone"))).when(size == 1, F.array(F.lit("@bar_lux.nyc"))).otherwise(F.array(F.lit("@nobody_else"))).alias("mentions"), F.lit("best Pizza in town").alias("text"), F.lit("@author").alias("author"))
    return enrich.places_by_rule(p).withColumn("confidence", F.col("confidence").cast("double"))


@query("SELECT o_orderkey AS id, upper(o_orderpriority) || '!' AS answer FROM orders")
def service_by_distinct_key(spark: SparkSession, d: str) -> DataFrame:
    """A service sees each priority once; every order gets its answer."""

    def service(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"o_orderpriority": batch["o_orderpriority"], "answer": batch["o_orderpriority"].str.upper() + "!"})

    return enrich.by_distinct_key(read(spark, d, "orders"), ["o_orderpriority"], service, "o_orderpriority string, answer string").select(F.col("o_orderkey").alias("id"), "answer")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Explorer' END AS display_name, c_mktsegment AS phone FROM customer")
def new_profiles(spark: SparkSession, d: str) -> DataFrame:
    c, key = read(spark, d, "customer"), F.col("c_custkey")
    meta = F.when(key % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("full_name")))).when(key % 3 == 1, "{}")
    return states.new_profiles(c.select(key.alias("id"), meta.alias("raw_user_meta_data"), F.col("c_mktsegment").alias("phone")))


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS t, CASE WHEN role = 'user' THEN role END AS s FROM conversations WHERE turn < 4)
SELECT conv_id, array_to_string(flatten(list(t ORDER BY turn)), '|') AS texts, coalesce(array_to_string(list(s ORDER BY turn) FILTER (s IS NOT NULL), chr(10) || chr(10)), '') AS transcript FROM w GROUP BY conv_id"""
)
def carousel_text(spark: SparkSession, d: str) -> DataFrame:
    """Turns as slides, of which the first four count."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("texts"), F.when(F.col("role") == "user", F.col("role")).alias("said"))
    return frames.carousel_text(c, "conv_id", "turn", "texts", "said").select("conv_id", F.array_join("texts", "|").alias("texts"), "transcript")


@query("SELECT '/f/frame_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.jpg' AS path, CAST(doc_id AS INTEGER) AS number, least((doc_id - 1) * 2.0, n_chars) AS seconds FROM documents")
def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as frame files of videos as long as their characters."""
    f = read(spark, d, "documents").select(F.concat(F.lit("/f/frame_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".jpg")).alias("path"), F.col("n_chars").alias("duration"))
    return frames.frame_files(f, "duration", 2.0).select("path", "number", F.col("seconds").cast("double").alias("seconds"))


# Status


@query(
    """SELECT event_id, '{"failed_stage":"' || event_type || '","error_code":"PIPELINE_ERROR","retryable":true,"error_message":"event ' || event_id || '"}' AS record,
'event: ' || CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE event_type END || chr(10) || 'data: {"post_id":' || user_id || ',"status":"' || CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END || '","error_message":"' || event_id || '"}' || chr(10) || chr(10) AS message FROM events"""
)
def status_messages(spark: SparkSession, d: str) -> DataFrame:
    """Failure records and event-stream messages of all events."""
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("post_id"), kind.alias("status"), F.col("event_id").cast("string").alias("error_message"), "event_type")
    said = sources.server_events(e).withColumn("event_id", F.regexp_extract("message", r'"error_message":"(\d+)"', 1).cast("long")).select("event_id", "message")
    return e.select("event_id", states.failure(F.col("event_type"), F.concat(F.lit("event "), "error_message")).alias("record")).join(said, "event_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS ocr, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS said FROM orders")
def merge_branches(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    ocr, said = o.where("id % 2 = 0").select("id", F.col("o_orderstatus").alias("ocr")), o.where("id % 3 = 0").select("id", F.col("o_orderpriority").alias("said"))
    return states.merge_branches(o.select("id"), "id", ocr, said)


_STAGE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'scraping' WHEN 'click' THEN 'scraped' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query(
    f"""WITH e AS (SELECT user_id, ts, event_id, s, CASE s WHEN 'pending' THEN 0 WHEN 'scraping' THEN 1 WHEN 'scraped' THEN 2 WHEN 'completed' THEN 6 ELSE 7 END AS r FROM (SELECT *, {_STAGE} AS s FROM events)),
m AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY ts, s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id AS post_id, s AS status, CASE before WHEN 0 THEN 'pending' WHEN 1 THEN 'scraping' WHEN 2 THEN 'scraped' END AS previous, epoch_us(ts) AS event_time FROM m WHERE before IS NULL OR before < 6 AND r > before"""
)
def status_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as status messages in a folder, followed as a stream until it has read them all."""
    folder = sources.scratch_folder(spark, "status")
    stage = F.expr(_STAGE)
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("post_id"), stage.alias("status"), F.col("ts").cast("timestamp").alias("event_time"))
    e.repartition(8).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
    changes = states.status_changes(sources.status_events(spark, f"{folder}/in"), give_up=None)
    writer = sources.to_folder(changes, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    got = spark.read.schema("post_id string, status string, previous string, error_message string, event_time timestamp").parquet(f"{folder}/out")
    return got.select(F.col("post_id").cast("long").alias("post_id"), "status", "previous", F.unix_micros("event_time").alias("event_time"))
