"""Operators on hand-written rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from placeloom import schemas
from placeloom.operators import analysis, enrich, frames, mutate, normalize, paging, places, policy, posts
from placeloom.sources import tables as sources


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, "Cafe X", "coffee", None, "Bar", "New York", 1, 10), (2, "Dojo", None, "Soho", "bar", "York", None, 30), (3, "Zoo", "x%y", None, None, "Paris", 2, None), (4, "cafe x", "", "", "  ", "new york", 9, 20)],
        "id long, name string, description string, neighborhood string, category string, city string, user_id long, created_at long",
    )


def test_filters(table):
    ids = lambda **f: [r["id"] for r in places.filtered(table, **f).orderBy("id").collect()]
    assert ids() == [1, 2, 3, 4]
    assert ids(search="CAFE") == [1, 4]
    assert ids(search="  ") == [1, 2, 3, 4]
    assert ids(category="B_r") == [1, 2]
    assert ids(city="york") == [1, 2, 4]
    assert ids(mine=True, user_id=2) == [3]
    with pytest.raises(PermissionError):
        places.filtered(table, mine=True)


def test_pages_put_together_are_the_whole(table):
    pages = [r["id"] for k in (1, 2, 3) for r in places.places_page(table, paging.Page(2, k)).collect()]
    assert pages == [3, 2, 4, 1]  # newest first, an unknown time before all
    assert [r["id"] for r in places.places_page(table, paging.Page(4, 1), "rating", True).collect()] == [1, 4, 2, 3]


def test_page_requests():
    assert paging.Page.of("500", "0", **paging.PLACES_PAGE) == paging.Page(100, 1)
    assert paging.Page.of(None, None, **paging.CITIES_PAGE) == paging.Page(50, 1)
    with pytest.raises(ValueError):
        paging.Page.of("0")
    with pytest.raises(ValueError):
        paging.Page.of("abc")


def test_envelope_and_total(spark, table):
    assert tuple(paging.envelope(table, paging.Page(3, 1)).first()) == (1, 3, 4, 2, True, False)
    assert {r["total_items"] for r in paging.with_total(table).collect()} == {4}
    assert tuple(paging.envelope(table.where("false"), paging.Page(3, 1)).first()) == (1, 3, 0, 0, False, False)


def test_lookup(table):
    assert paging.lookup(table, "id", 1)["name"] == "Cafe X"
    assert paging.lookup(table, "id", 99) is None
    with pytest.raises(LookupError):
        paging.lookup(table, "id", 99, exactly=True)
    with pytest.raises(LookupError):
        paging.lookup(table.union(table), "id", 1)


def test_creators(spark, table):
    profiles = spark.createDataFrame([(1, "Ann"), (2, "")], "pid long, display_name string")
    got = paging.with_creator(table, profiles, "user_id", "pid", "display_name").select("id", "created_by")
    assert rows(got, "id") == [(1, "Ann"), (2, "Anonymous"), (3, "Anonymous"), (4, "Anonymous")]


def test_categories(table):
    assert rows(places.categories(table), "category") == [("Bar",), ("bar",)]
    assert rows(places.categories(table, search="B_r")) == []


def test_saved_pages(spark):
    saved = spark.createDataFrame([(7, k, 100 - k) for k in range(1, 13)], "user_id long, place_id long, created_at long")
    table = spark.createDataFrame([(k, "hit" if k == 11 else "other", None, None, None, None) for k in range(1, 13)], "id long, name string, description string, neighborhood string, category string, city string")
    assert rows(places.saved_page(saved, table, 7, paging.Page(10, 1), compat=True, search="hit")) == []
    assert [r["id"] for r in places.saved_page(saved, table, 7, paging.Page(10, 1), search="hit").collect()] == [11]
    assert [r["id"] for r in places.saved_page(saved, table, 7, paging.Page(3, 1)).collect()] == [1, 2, 3]


def test_place_dedup(spark):
    got = spark.createDataFrame([(1, " Cafe X", "NYC"), (2, "cafe x", "nyc "), (3, "", "NYC"), (4, None, "x"), (5, "Cafe X", None)], "pos long, name string, city string")
    assert [r["pos"] for r in places.distinct_places(got, [], ["pos"]).orderBy("pos").collect()] == [1, 5]
    twice = places.distinct_places(places.distinct_places(got, [], ["pos"]), [], ["pos"])
    assert twice.count() == 2
    existing = spark.createDataFrame([("CAFE X", "nyc")], "name string, city string")
    assert [r["pos"] for r in places.new_rows(got.where("name <> ''"), existing, ["name", "city"]).collect()] == [5]


def test_pick_post(spark):
    got = spark.createDataFrame([("u", "b", "failed", 9), ("u", "a", "completed", 5), ("v", "c", "pending", 1), ("v", "d", None, 2)], "url string, id string, status string, created_at long")
    assert rows(posts.pick_post(got, ["url"]).select("url", "id"), "url") == [("u", "a"), ("v", "d")]


def test_places_of_posts(spark):
    p = spark.createDataFrame([("p1", "a", "url"), ("p2", None, "url"), ("p3", "gone", None)], "id string, place_id string, post_url string")
    t = spark.createDataFrame([("a", "url"), ("b", "url"), ("c", None)], "id string, source_url string")
    assert rows(posts.places_of_posts(p, t), "post_id", "rank", "place_id") == [("p1", "a", 0), ("p1", "b", 1), ("p2", "a", 1), ("p2", "b", 1)]


def _shared(spark):
    return {
        "lists": spark.createDataFrame([(1, "ann", True), (2, "ann", False), (3, "bob", None), (4, "bob", False)], "id long, user_id string, is_public boolean"),
        "list_collaborators": spark.createDataFrame([(3, "cy", "viewer"), (4, "cy", "editor"), (4, "ann", "editor")], "list_id long, user_id string, role string"),
        "list_places": spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "list_id long, place_id long"),
        "guides": spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_published boolean"),
        "guide_places": spark.createDataFrame([(1, 1), (2, 2)], "id long, guide_id long"),
        "saved_places": spark.createDataFrame([("ann", 1), ("bob", 2)], "user_id string, place_id long"),
        "waitlist": spark.createDataFrame([("x@y",)], "email string"),
        "places": spark.createDataFrame([(1,)], "id long"),
    }


def test_visibility(spark):
    t = _shared(spark)
    seen = lambda name, uid: sorted(r[0] for r in policy.visible(name, t, uid).collect())
    assert seen("lists", None) == [1]
    assert seen("lists", "ann") == [1, 2, 4]
    assert seen("lists", "cy") == [1, 3, 4]
    assert set(seen("lists", None)) <= set(seen("lists", "cy"))
    assert seen("list_places", "cy") == [1, 3, 4]
    assert seen("list_collaborators", "cy") == [3, 4]
    assert seen("list_collaborators", "bob") == [3, 4, 4]
    assert seen("guides", None) == [1] and seen("guides", "x") == [1, 2, 3]
    assert seen("guide_places", None) == [1]
    assert seen("saved_places", None) == [] and seen("saved_places", "ann") == ["ann"]
    assert policy.visible("waitlist", t, email="admin@x").count() == 1
    assert policy.visible("waitlist", t, email="Admin@x").count() == 0
    with pytest.raises(KeyError):
        policy.visible("secrets", {"secrets": t["lists"]}, "ann")


def test_write_rules(spark):
    t = _shared(spark)
    may = lambda name, action, uid: sorted(r[0] for r in policy.may_write(name, action, t[name], t, uid).collect())
    assert may("list_places", "insert", "cy") == [4]  # a viewer may not
    assert may("list_places", "delete", "ann") == [1, 2, 4]
    assert may("lists", "update", "bob") == [3, 4]
    assert may("places", "insert", None) == [] and may("places", "insert", "x") == [1]
    assert may("places", "delete", "x") == []
    assert may("waitlist", "insert", None) == ["x@y"]
    assert rows(policy.editable_lists(t, "ann"), "list_id") == [(1,), (2,), (4,)]
    claims = spark.createDataFrame([('{"email":"an.admin@x"}',), ("{}",), (None,)], "c string")
    assert [r[0] for r in claims.select(policy.is_admin("c")).collect()] == [True, False, False]


def test_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "id long, v string")
    assert rows(mutate.insert_ignore(target, new, ["id"]), "id") == [(None, "n"), (1, "a"), (2, "b"), (3, "c")]
    once = mutate.upsert(target, new, ["id"])
    assert rows(once, "id") == [(None, "n"), (1, "a"), (2, "B"), (3, "c")]
    assert rows(mutate.upsert(once, new, ["id"]), "id") == rows(once, "id")
    assert rows(mutate.delete(target, new, ["id"]), "id") == [(None, "n"), (1, "a")]
    assert rows(mutate.update(target, spark.createDataFrame([(1, None)], "id long, v string"), ["id"]), "id") == [(None, "n"), (1, None), (2, "b")]
    assert rows(mutate.attach(target, spark.createDataFrame([(1, "z")], "id long, v string"), "id", "v"), "id") == [(None, "n"), (1, "z"), (2, "b")]
    assert rows(mutate.duplicates(new, ["id"])) == [(3, 2)]


def test_sparse_update(spark):
    target = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id long, name string, phone string")
    patch = spark.createDataFrame([(1, None, True, "x", False), (9, "z", True, None, False)], "id long, name string, has_name boolean, phone string, has_phone boolean")
    assert rows(mutate.sparse_update(target, patch, "id", ["name", "phone"]), "id") == [(1, None, "p"), (2, "b", "q")]
    assert [r["id"] for r in mutate.unmatched(target, patch, "id").collect()] == [9]
    with pytest.raises(ValueError):
        mutate.sparse_update(target, patch, "id", [])


def test_duplicate_key_merge(spark):
    base = spark.createDataFrame([("old", "tiktok", "c1", "completed", "x"), ("new", "tiktok", "pending_1", "scraping", None), ("solo", "tiktok", "pending_2", "scraping", None)], "id string, platform string, content_id string, status string, caption string")
    saved = spark.createDataFrame([("new", "tiktok", "c1", "y"), ("solo", "tiktok", "c2", "z")], "id string, platform string, content_id string, caption string")
    got = mutate.merge_duplicate(base, saved, ["caption"]).select("id", "content_id", "status", "caption")
    assert rows(got, "id") == [("new", "pending_1", "completed", None), ("old", "c1", "completed", "y"), ("solo", "c2", "completed", "z")]


def test_cascade(spark):
    t = {
        "social_posts": spark.createDataFrame([("s1", "p1"), ("s2", "p2")], "id string, place_id string"),
        "places": spark.createDataFrame([("p1", "s1"), ("p2", None)], "id string, social_post_id string"),
        "saved_places": spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "id string, place_id string"),
    }
    left = mutate.delete_cascading(t, "social_posts", spark.createDataFrame([("s1",)], "id string"))
    assert rows(left["places"]) == [("p2", None)]
    assert rows(left["saved_places"]) == [("k2", "p2")]
    left = mutate.delete_cascading(t, "places", spark.createDataFrame([("p2",)], "id string"))
    assert rows(left["social_posts"], "id") == [("s1", "p1"), ("s2", None)]


def test_user_goes_by_every_way(spark):
    """Collaborators go with their user and with the lists of their user; a place keeps its row."""
    t = {
        "profiles": spark.createDataFrame([(1,), (2,)], "id long"),
        "lists": spark.createDataFrame([(10, 1), (11, 2)], "id long, user_id long"),
        "list_collaborators": spark.createDataFrame([(20, 10, 2), (21, 11, 1), (22, 11, 2), (23, 11, 3)], "id long, list_id long, user_id long"),
        "list_places": spark.createDataFrame([(30, 10, 5), (31, 11, 5)], "id long, list_id long, place_id long"),
        "follows": spark.createDataFrame([(40, 1, 2), (41, 2, 1), (42, 2, 3)], "id long, follower_id long, following_id long"),
        "places": spark.createDataFrame([(5, 1), (6, 2)], "id long, user_id long"),
    }
    left = mutate.delete_cascading(t, "users", spark.createDataFrame([(1,)], "id long"))
    assert {k: [r["id"] for r in v.orderBy("id").collect()] for k, v in left.items()} == {"profiles": [2], "lists": [11], "list_collaborators": [22, 23], "list_places": [31], "follows": [42], "places": [5, 6]}
    assert rows(left["places"], "id") == [(5, None), (6, 2)]
    assert rows(t["places"], "id") == [(5, 1), (6, 2)]


def test_latest_of_a_hot_key(spark):
    many = spark.range(10_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 10_007).alias("t"), F.col("id"))
    got = mutate.latest(many, ["k"], ["t", "id"])
    assert got.columns == many.columns and got.first()["t"] == many.agg(F.max("t")).first()[0]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_schemas(spark):
    bad = spark.createDataFrame([(None, "u", 1), ("x", "u", 1)], "id string, user_id string, place_id long")
    found = {k: v.count() for k, v in mutate.violations("saved_places", bad).items()}
    assert found["unique(user_id, place_id)"] == 1 and found["not null(id)"] == 1 and found["unique(id)"] == 0
    assert mutate.with_defaults(spark.range(1), "lists").first()["is_public"] is True
    assert set(schemas.UNIQUE) | {"audio_uploads"} == set(schemas.TABLES)


TSV = "\n".join(
    ["\t".join("level page_num block_num par_num line_num word_num left top width height conf text".split())]
    + ["\t".join(map(str, [level, 1, b, 1, line, w, 0, 0, 0, 0, conf, t])) for level, b, line, w, conf, t in [
        (4, 1, 1, 0, 95, "header"), (5, 1, 1, 1, 96.5, "Menu"), (5, 1, 1, 2, 59, "dim"), (5, 1, 1, 3, 60, "₹15O"), (5, 1, 2, 1, -1, "gone"), (5, 1, 2, 2, 90, "***"), (5, 2, 1, 1, 90, "abc"), (5, 3, 1, 1, 88, "abcd")]]
    + ["short\trow"]
)


def test_ocr_lines(spark):
    table = spark.createDataFrame([(1, TSV), (2, ""), (3, None)], "id long, tsv string")
    found = frames.words(table, ["id"])
    assert found.count() == 6
    assert [r["text"] for r in frames.clean_lines(found, ["id"]).orderBy("line_no").collect()] == ["Menu ₹150", "abcd"]


def test_text_across_frames(spark):
    lines = spark.createDataFrame([(1, 0, 0, "Hello  World"), (1, 1, 0, "hello world"), (1, 1, 1, "New"), (1, 2, 0, "x"), (2, 0, 0, "new")], "post long, frame int, pos int, text string")
    got = frames.unique_across_frames(lines, ["post"], "frame", "pos")
    assert rows(got, "post", "frame", "pos") == [(1, 0, 0, "Hello  World"), (1, 1, 1, "New"), (1, 2, 0, "x"), (2, 0, 0, "new")]
    again = frames.unique_across_frames(got, ["post"], "frame", "pos")
    assert rows(again, "post", "frame", "pos") == rows(got, "post", "frame", "pos")
    assert rows(frames.collapsed(lines, ["post"], "frame", "pos"), "post") == [(1, ["Hello  World", "New"]), (2, ["new"])]


def test_frames_of_a_video(spark):
    f = spark.createDataFrame([("v", 3, "a"), ("v", 1, "a"), ("v", 2, "b"), ("v", 4, "c")], "video string, index int, content string")
    assert [r["index"] for r in frames.distinct_frames(f, "video", "index", "content", 2).orderBy("index").collect()] == [1, 2]
    files = spark.createDataFrame([("/x/frame_003.jpg", 1.5)], "path string, duration double")
    assert tuple(frames.frame_files(files, "duration").select("number", "seconds").first()) == (3, 1.5)
    slides = spark.createDataFrame([(1, 1, ["b"], "two"), (1, 0, ["a"], "one"), (1, 9, ["z"], "late"), (1, 2, None, "")], "post long, slide int, texts array<string>, said string")
    assert tuple(frames.carousel_text(slides, "post", "slide", "texts", "said").first()) == (1, ["a", "b"], "one\n\ntwo")
    attrs = spark.createDataFrame([(1, 1, ["B", "A"]), (1, 0, ["A", ""]), (1, 2, None)], "post long, frame int, brands array<string>")
    assert tuple(frames.aggregated(attrs, ["post"], "frame", ["brands"]).first()) == (1, ["A", "B"])


def _raw(spark, tmp_path, source, docs):
    path = tmp_path / f"{source}.json"
    path.write_text("\n".join(json.dumps(x) for x in docs))
    return sources.crawled(spark, str(path), source)


def test_instagram(spark, tmp_path):
    raw = _raw(spark, tmp_path, "instagram", [
        {"id": "1", "type": "Video", "likesCount": -1, "commentsCount": 5, "videoViewCount": 100, "videoDuration": 0, "dimensionsWidth": 9, "dimensionsHeight": 16, "videoUrl": "v"},
        {"id": "2", "type": "Video", "videoUrl": "v", "childPosts": [{"displayUrl": "", "url": "u"}, {"displayUrl": "d"}], "likesCount": 0},
        {"shortCode": "s", "displayUrl": "pic", "dimensionsWidth": 0, "dimensionsHeight": 5},
    ])
    got = {r["content_id"]: r for r in normalize.instagram(raw).collect()}
    assert got["1"]["content_type"] == "reel" and got["1"]["metrics"]["likes"] is None and got["1"]["video_duration"] is None
    assert tuple(got["1"]["dimensions"]) == (9, 16) and got["1"]["author_username"] == "unknown"
    assert got["2"]["content_type"] == "post" and got["2"]["images"] == ["u", "d"] and got["2"]["metrics"]["likes"] == 0
    assert got["s"]["images"] == ["pic"] and got["s"]["dimensions"] is None and got["s"]["hashtags"] == []


def test_tiktok(spark, tmp_path):
    raw = _raw(spark, tmp_path, "tiktok", [
        {"id": "1", "slideshowImageLinks": [], "imageUrls": ["x"], "hashtags": [{"name": "a"}, {"title": "b"}, "c"], "createTime": 86400, "diggCount": 3, "playCount": 7},
        {"id": "2", "images": ["p", {"url": ""}, {"display_image": {"url_list": ["q"]}}], "musicMeta": {"musicName": "song"}, "isAd": True},
        {"id": "3", "imagePost": {"images": [{"imageURL": {"urlList": ["z"]}}]}, "videoMeta": {"duration": 0, "width": 9}, "createTimeISO": "2024-01-01T00:00:00.000Z"},
        {"id": "4", "postType": "slideshow", "authorMeta": {"name": "me", "nickName": "Me"}},
        {"id": "5", "slideshowImageLinks": [{"downloadLink": "", "tiktokLink": "t"}, "s"], "videoMeta": {"originalCoverUrl": "", "dynamicCoverUrl": "d"}},
    ])
    got = {r["content_id"]: r for r in normalize.tiktok(raw).collect()}
    assert got["1"]["images"] is None and got["1"]["content_type"] == "video" and got["1"]["hashtags"] == ["a", "b", "c"]
    assert got["1"]["published_at"] == "1970-01-02T00:00:00.000Z" and got["1"]["metrics"]["plays"] == 7
    assert got["2"]["images"] == ["p", "q"] and got["2"]["content_type"] == "post" and got["2"]["paid_partnership"] and got["2"]["music_info"]["song_name"] == "song"
    assert got["3"]["images"] == ["z"] and got["3"]["video_duration"] is None and tuple(got["3"]["dimensions"]) == (9, None) and got["3"]["music_info"] is None
    assert got["4"]["content_type"] == "post" and got["4"]["author_full_name"] == "Me"
    assert got["5"]["images"] == ["t", "s"] and got["5"]["display_url"] == "d"


def test_analysis_of_a_post(spark, tmp_path):
    ig = _raw(spark, tmp_path, "instagram", [{"id": "1", "type": "Video", "videoUrl": "v", "likesCount": 10, "commentsCount": 5, "videoViewCount": 300, "caption": "hi", "hashtags": ["x"], "dimensionsWidth": 9, "dimensionsHeight": 16, "url": "u"}])
    content = normalize.posts(ig, _raw(spark, tmp_path, "tiktok", [{"id": "2", "text": "t"}]))
    answer = json.dumps({"content": {"summary": "S", "primary_category": "food"}, "entities": {"brands": [{"name": "A"}, {"name": ""}]}, "visual_analysis": {"brands_visible": ["A", "B"]}, "promotion": {"is_promotional": False}})
    full = content.withColumn("answer", F.when(F.col("content_id") == "1", answer).otherwise("not json")).withColumn("transcript", F.lit("")).withColumn("ocr_texts", F.array(F.lit("b"), F.lit("a")))
    done = analysis.sections(full)
    assert len(done.schema["analysis"].dataType.fieldNames()) == 16
    first, second = (r["analysis"] for r in done.orderBy("content_id").collect())
    assert first["content"]["found"]["summary"] == "S" and first["content"]["dimensions"]["orientation"] == "vertical"
    assert first["promotion"]["is_promotional"] is False and first["engagement"]["likes"] == 10 and first["hashtags"]["all"] == ["x"]
    assert second["content"]["found"]["summary"] == "" and second["entities"]["brands"] == [] and second["data_quality"]["ocr_available"] is True
    assert "likes" in second["data_quality"]["unavailable_metrics"]
    extra = done.withColumn("place_ids", F.array(F.lit("p1"), F.lit("p2"))).withColumn("user_id", F.lit("")).withColumn("vision_texts", F.array(F.lit("a"), F.lit("c")))
    row = analysis.saved_post(extra).where("content_id = '1'").first()
    assert row["mentioned_brands"] == ["A", "B"] and float(row["engagement_rate"]) == 5.0 and row["place_id"] == "p1" and row["user_id"] is None
    assert row["ocr_combined_text"] == "a c b" and row["status"] == "completed" and row["likes"] == 10 and row["whisper_transcript"] is None
    other = analysis.saved_post(extra).where("content_id = '2'").first()
    assert other["mentioned_brands"] is None and other["likes"] == 0 and other["engagement_rate"] is None and other["video_plays"] is None
    assert tuple(normalize.card(content).where("content_id = '1'").select("likes", "comments", "status").first()) == (10, 5, "scraped")


def test_geocoding_and_saving(spark):
    gazetteer = spark.createDataFrame([("Cafe X", "NYC", 40.7, -74.0, "1 Road", "Soho"), ("", "NYC", 40.71, -74.01, "NYC", None)], "name string, city string, latitude double, longitude double, address string, neighborhood string")
    got = spark.createDataFrame([(1, " cafe x", "nyc", None, None, None, None, None), (2, "Other", "NYC", "own", "mine", "", "d", "@h"), (3, "Lost", None, None, None, None, None, None)], "id long, name string, city string, address string, neighborhood string, category string, description string, creator_handle string")
    found = enrich.geocode(got, gazetteer)
    saved = enrich.saved_place(found)
    assert rows(saved.select("name", "address", "neighborhood", "category", "latitude"), "name") == [("Lost", "", None, "Restaurants", None), ("Other", "own", "mine", "Restaurants", 40.71), ("cafe x", "1 Road", "Soho", "Restaurants", 40.7)]
    points = spark.createDataFrame([(1, 40.7001, -74.0001), (2, 0.0, 5.0), (3, None, None)], "id long, latitude double, longitude double")
    assert rows(enrich.reverse_geocode(points, gazetteer, cell=1.0).select("id", "found_neighborhood"), "id") == [(1, "Soho"), (2, ""), (3, "")]


def test_services_see_each_key_once(spark):
    def lengths(batches):
        for b in batches:
            yield b.assign(n=b["k"].fillna("").str.len(), calls=1)

    t = spark.createDataFrame([("aa",), ("aa",), (None,)], "k string")
    got = enrich.by_distinct_key(t, ["k"], lengths, "k string, n long, calls long")
    assert rows(got, "k") == [(None, 0, 1), ("aa", 2, 1), ("aa", 2, 1)]
    p = spark.createDataFrame([(1, ["@tashca.nyc", "@plain"], "fresh croissant", "me")], "id long, mentions array<string>, text string, author string")
    assert rows(enrich.places_by_rule(p)) == [(1, "Tashca", "New York", "Artisanal Bakery & Cafe", "@me", 0.5)]


def test_texts_in_frame_order(spark):
    rows = spark.createDataFrame([("v", 10, "c"), ("v", 2, "b"), ("v", 2, "a"), ("v", 1, None), ("w", None, "x"), ("u", 1, None), ("v", 2, "a")], "video string, frame int, text string")
    got = {r["video"]: r["texts"] for r in frames.in_frame_order(rows, "video", "frame", "text").collect()}
    assert got == {"v": ["a", "a", "b", "c"], "w": ["x"], "u": []}
    assert frames.in_frame_order(rows.where("false"), "video", "frame", "text").count() == 0
