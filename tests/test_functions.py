"""Column functions on hand-written edge rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from placeloom.functions import arrays, media, numbers, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    row = spark.range(1)
    for k, v in values.items():
        if isinstance(v, list):
            row = row.withColumn(k, F.array(*[F.lit(x) for x in v]).cast("array<string>"))
        elif isinstance(v, tuple):  # a null of a kind
            row = row.withColumn(k, F.lit(None).cast(v[0]))
        else:
            row = row.withColumn(k, F.lit(v).cast(kinds[type(v)]))
    return row.select(column.alias("x")).first()["x"]


def test_false_values_are_null(spark):
    assert one(spark, text.falsy_to_null("c"), c="") is None
    assert one(spark, text.falsy_to_null("c"), c=" ") == " "
    assert one(spark, text.falsy_to_null("c", "number"), c=0) is None
    assert one(spark, text.falsy_to_null("c", "number"), c=float("nan")) is None
    assert one(spark, text.falsy_to_null("c", "number"), c=-1) == -1
    assert one(spark, text.falsy_to_null("c", "boolean"), c=False) is None
    assert one(spark, text.either("a", "b"), a="", b="x") == "x"


def test_trim_takes_all_white_space(spark):
    assert one(spark, text.trim_space("c"), c="\t  x y　\n") == "x y"
    assert one(spark, text.text_key("c"), c="  Hello \t World ") == "hello world"
    assert one(spark, text.is_blank("c"), c=" \n") is True
    assert one(spark, text.is_blank("c"), c=("string",)) is True


@pytest.mark.parametrize(("token", "noise"), [("a", True), ("***", True), ("a|b", True), ("IV", True), ("हिन्दी", False), ("15", False), ("IVXLC", False), ("ok", False), ("§1", True)])
def test_noise_tokens(spark, token, noise):
    assert one(spark, text.is_noise("c"), c=token) is noise


def test_price_fix(spark):
    assert one(spark, text.fix_price("c"), c="₹15O") == "₹150"
    assert one(spark, text.fix_price("c"), c="FOO") == "FOO"


def test_search_wildcards(spark):
    assert one(spark, text.like_any_case("c", "B_r", whole=True), c="bar") is True
    assert one(spark, text.contains_text("c", "B_r"), c="Bar") is False
    assert one(spark, text.like_any_case("c", "x"), c=("string",)) is None


def test_slug(spark):
    slug = one(spark, text.slugify("c", "k"), c=" My Best! List ", k=7)
    assert slug.startswith("my-best-list-") and len(slug) == len("my-best-list-") + 4
    assert slug == one(spark, text.slugify("c", "k"), c=" My Best! List ", k=7)


def test_handles(spark):
    assert one(spark, text.handle_city("c"), c="@tashca.nyc") == "New York"
    assert one(spark, text.handle_city("c"), c="plain") is None
    assert one(spark, text.handle_name("c"), c="@carbone_la") == "Carbone"
    assert one(spark, text.handle("c"), c=" @me ") == "@me"


def test_categories_by_keyword(spark):
    assert one(spark, text.keyword_category("c"), c="Best POUR OVER in town") == "Specialty Coffee Roastery & Cafe"
    assert one(spark, text.keyword_category("c"), c="omakase and pizza") == "Omakase Sushi Bar"
    assert one(spark, text.keyword_category("c"), c="nothing") == "Restaurant"


def test_search_tokens(spark):
    assert one(spark, text.search_tokens("c"), c="The cat, the CAT and a dog!") == ["cat", "dog"]
    assert one(spark, text.search_tokens("c"), c=("string",)) == []


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://WWW.Example.com:443/p/A?x=1#y", "https://www.example.com/p/A"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com:8080?x", "http://example.com:8080/"),
        ("no url", "no url"),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, urls.canonical_url("c"), c=url) == canonical


def test_spellings_of_a_post_share_a_key(spark):
    base = "https://www.instagram.com"
    keys = {one(spark, urls.post_key("c"), c=f"{base}/{kind}/Abc{end}") for kind in ("reel", "reels") for end in ("", "/", "/?igsh=1")}
    assert keys == {f"{base}/reel/Abc"}
    assert len(one(spark, urls.url_variants("c"), c=f"{base}/reels/Abc/")) == 4


def test_instagram_urls(spark):
    assert one(spark, urls.instagram_url("c"), c=" instagram.com/p/X/?a=b ") == "https://www.instagram.com/p/X"
    assert one(spark, urls.instagram_url("c"), c="https://example.com/p/X/") == "https://example.com/p/X/"
    assert one(spark, urls.platform("c"), c="https://vm.tiktok.com/x") == "tiktok"
    assert one(spark, urls.strict_platform("c"), c="https://example.com") is None
    assert one(spark, urls.uri_encode("c"), c="a b&c") == "a%20b%26c"


@pytest.mark.parametrize(("x", "y"), [(-2.5, -2), (2.5, 3), (2.4, 2), (-2.6, -3)])
def test_halves_round_up(spark, x, y):
    assert one(spark, numbers.round_half_up("c"), c=x) == y


def test_rounding_of_nothing(spark):
    assert one(spark, numbers.round_half_up("c", 0), c=("double",)) == 0
    assert one(spark, numbers.round_half_up("c"), c=("double",)) is None


def test_engagement(spark):
    rate = numbers.engagement_rate("l", "c", "v")
    assert float(one(spark, rate, l=10, c=5, v=300)) == 5.0
    assert one(spark, rate, l=1, c=1, v=0) is None
    assert one(spark, rate, l=("long",), c=5, v=100) is None
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        one(spark, rate, l=1_000_000, c=0, v=1)


def test_times(spark):
    assert one(spark, numbers.published_at("i", "e"), i=("string",), e=0) is None
    got = one(spark, numbers.published_at("i", "e").cast("timestamp_ntz"), i=("string",), e=86_400)
    assert got == datetime.datetime(1970, 1, 2)
    got = one(spark, numbers.published_at("i", "e").cast("timestamp_ntz"), i="2024-02-03T04:05:06Z", e=86_400)
    assert got == datetime.datetime(2024, 2, 3, 4, 5, 6)


def test_small_numbers(spark):
    assert one(spark, numbers.clamp("c", 1, 100), c=500) == 100
    assert one(spark, numbers.total_pages("c", 10), c=21) == 3
    assert one(spark, numbers.percent_text("c"), c=0.456) == "46%"
    assert one(spark, numbers.number_text("c"), c=1234567) == "1,234,567"


def test_arrays(spark):
    assert one(spark, arrays.first_seen("a", "b"), a=["A", ""], b=["A", "B"]) == ["A", "B"]
    assert one(spark, arrays.first_seen("a", "b"), a=("array<string>",), b=["x"]) == ["x"]
    assert one(spark, arrays.combined_text("a", "b"), a=["b", "a"], b=["a", "c", None]) == "b a c"
    assert one(spark, arrays.combined_text("a"), a=[""]) is None
    assert one(spark, arrays.empty_to_null("a"), a=[]) is None
    assert one(spark, arrays.first_or_null("a"), a=[]) is None
    assert one(spark, arrays.clean_array("a"), a=[" x ", "", None]) == ["x"]
    assert one(spark, arrays.clean_array("a"), a=("array<string>",)) == []
    known, unknown = arrays.known_and_unknown({"a": "a", "b": "b"})
    assert one(spark, F.struct(known.alias("k"), unknown.alias("u")), a=1, b=("long",)) == (["a"], ["b"])


def test_find_in_structs(spark):
    row = spark.sql("select array(named_struct('id','place.1','text','P'), named_struct('id','locality.2','text','L'), named_struct('id',null,'text','N')) as c, array(named_struct('types',array('x'),'long_name','X'), named_struct('types',array('y','neighborhood'),'long_name','Y')) as g")
    got = row.select(arrays.find_by_prefix("c", "id", ["neighborhood.", "locality."], "text"), arrays.find_by_member("g", "types", ["neighborhood"], "long_name"), arrays.find_by_prefix("c", "id", ["zzz"], "text")).first()
    assert tuple(got) == ("L", "Y", None)


def test_json(spark):
    assert one(spark, arrays.json_or_wrapped("c"), c='{"a":1}') == '{"a":1}'
    assert one(spark, arrays.json_or_wrapped("c"), c="broken") == '{"error_message":"broken"}'
    assert one(spark, arrays.json_text("c", "$.full_name", "Explorer"), c="{}") == "Explorer"


def test_media(spark):
    may = media.may_upload("m", "n", "s")
    assert one(spark, may, m="audio/ogg", n="x", s=10) is True
    assert one(spark, may, m="", n="x.MP3", s=10) is True
    assert one(spark, may, m="", n="x.mp3", s=media.MOST_UPLOAD_BYTES + 1) is False
    assert one(spark, may, m=("string",), n="x.txt", s=1) is False
    kind = media.media_kind("v", "t", "i")
    assert one(spark, kind, v="u", t="reel", i=["a", "b"]) == "video"
    assert one(spark, kind, v="u", t="post", i=["a", "b"]) == "carousel"
    assert one(spark, kind, v="", t="sidecar", i=["a"]) == "carousel"
    assert one(spark, kind, v="u", t="", i=("array<string>",)) == "video"
    assert one(spark, kind, v="", t="reel", i=["a"]) == "image"


@pytest.mark.parametrize(("seconds", "n"), [(15, 3), (16, 5), (30, 5), (31, 6), (0, 3)])
def test_frame_budget(spark, seconds, n):
    assert one(spark, media.frame_budget("d"), d=float(seconds)) == n


def test_frames(spark):
    assert one(spark, media.frame_budget("d"), d=("double",)) == 3
    assert one(spark, media.frame_number("p"), p="/tmp/frame_0042.jpg") == 42
    assert one(spark, media.frame_time("n", "d"), n=9, d=4.5) == 4.5
    assert one(spark, media.sample_times("d"), d=4.4) == pytest.approx([0, 1.1, 2.2, 3.3])
    assert one(spark, media.sample_times("d"), d=0.2) == []
    assert len(one(spark, media.sample_times("d"), d=500.0)) == 30
    assert one(spark, media.orientation("w", "h"), w=9, h=16) == "vertical"
    assert one(spark, media.known_duration("d"), d=("double",)) == 60.0


def test_noise_is_told_in_one_pass(spark):
    """The rules one by one, on odd tokens; the token is trimmed once and matched once."""
    import itertools
    import re

    some = ["".join(x) for n in (0, 1, 2, 3) for x in itertools.product(["I", "a", "é", "7", "₹", "-", "|", "§", " ", "\n", "\u0085", "\U0001d11e"], repeat=n)] + ["IVXI", "IVXIV", "x" * 5000 + "~", "-" * 5000, "^" * 5000 + "a"]
    t = text.trim_space("w")
    rules = (F.length(t) < text.LEAST_TOKEN) | ~t.rlike(r"[\p{L}\p{N}]") | t.rlike(text.NOISE_SYMBOLS) | t.rlike(text.LONE_NUMERAL)
    df = spark.createDataFrame([*[(w,) for w in some], (None,)], "w string")
    assert df.where(~text.is_noise("w").eqNullSafe(rules)).count() == 0
    plan = df.where(text.is_noise("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RLIKE", plan)) == 1
