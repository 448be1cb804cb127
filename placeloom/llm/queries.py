"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN
from . import align, chroma, exact, htmltext, langid, mixing, packing, periodic, quality, recordings, sharding, simhash, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer that the queries use; the operators take a path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Dated entries of the query's list: list, effect, kind, pattern, action, day of 2024.
LIST_ENTRIES = [
    ("spam", "block", "domain", "spam-farm.example.org", "add", 20),
    ("spam", "block", "domain", "spam-farm.example.org", "remove", 150),
    ("spam", "block", "domain", "spam-farm.example.org", "add", 200),
    ("partners", "allow", "prefix", "spam-farm.example.org/en", "add", 260),
    ("partners", "allow", "prefix", "spam-farm.example.org/en", "remove", 300),
    ("region", "block", "domain", "example.net", "add", 100),
    ("region", "block", "domain", "example.net", "remove", 130),
]
_YEAR = 1_704_067_200  # 2024-01-01 UTC
_DAY = 86_400


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, fetched through 2024, against a fixed list and one entry for each of the hosts whose hash chooses it."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.lit(_YEAR) + F.pmod(F.col("page_id") * 7919, F.lit(527_040)) * 60)
    fixed = spark.createDataFrame([(*e[:5], _YEAR + e[5] * _DAY) for e in LIST_ENTRIES], "list string, effect string, kind string, pattern string, action string, at long")
    host = urlfilter.host_of(F.col("url"))
    hosts = pages.select(host.alias("h")).where("h is not null").distinct().withColumn("x", F.conv(F.substring(F.md5("h"), 1, 7), 16, 10).cast("long"))
    at = F.lit(_YEAR) + F.pmod(F.col("x"), F.lit(300)) * _DAY
    entry = lambda name, effect, kind, pattern, action, when: F.struct(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), when.cast("long").alias("at"))
    per_host = F.array(
        entry("hosts", "block", "host", F.col("h"), "add", at),
        entry("hosts", "block", "host", F.when(F.col("x") % 2 == 0, F.col("h")), "remove", at + 45 * _DAY),
        entry("paths", "allow", "prefix", F.when(F.col("x") % 3 == 0, F.concat("h", F.lit("/de"))), "add", at + 10 * _DAY),
    )
    grown = hosts.where("x % 5 = 0").select(F.explode(per_host).alias("e")).select("e.*")
    return urlfilter.evaluate(captures, fixed.unionByName(grown))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    models = langid.train(docs.where(~held_out))
    return langid.identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.learn(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = "tag:placeloom.invalid,2025:page/"
    read = warc.archive(_read(spark, sf_dir, "pages"), prefix)
    page = lambda c: F.substring_index(c, "/", -1).try_cast("long")  # noqa: E731  a null id is written as none
    return read.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from all rows of ``embeddings``; those whose id is divisible by 50 are looked up among all."""
    media = recordings.recordings(_read(spark, sf_dir, "embeddings"))
    return chroma.align(chroma.fingerprints(media), "id % 50 = 0")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.signals(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.group_equal(_read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a tenth of the documents are made to repeat themselves from some word on."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    n, g = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long"), F.floor(hashed / 10)
    begin = F.pmod(g, F.greatest(n, F.lit(1)))
    period = 1 + F.floor((n - begin) / (3 + F.pmod(g, F.lit(8))))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when((hashed % 10 == 0) & (n > 0), periodic.looped(F.col("text"), begin, period)).otherwise(F.col("text")).alias("text"))
    best = periodic.longest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return periodic.runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_warc": op4_warc,
    "op5_media_columns": op5_media_columns,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Targets by sources: capped sources are those whose cap per weight is least, as many as leave no other above its cap.
_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM ranked),
levels AS (
  SELECT k - 1 AS capped,
         CAST((SELECT sum(source_size) FROM ranked) - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE)
           / CAST((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT level FROM levels l
  WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.k > l.capped AND o.weight * l.level > 3 * o.source_size)
  ORDER BY capped LIMIT 1),
goals AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM ranked, chosen),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
hashes AS (
  SELECT source, hash, sum(size) AS size FROM sized GROUP BY ALL),
upto AS (
  SELECT source, hash, size, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM hashes),
more AS (
  SELECT u.source, u.hash,
         CASE WHEN u.upto <= b.target - b.whole * b.source_size THEN 1
              WHEN u.upto - u.size <= b.target - b.whole * b.source_size
                   AND 2 * (b.target - b.whole * b.source_size - (u.upto - u.size)) >= u.size THEN 1 ELSE 0 END AS extra
  FROM upto u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, b.source_size, b.target, CAST(s.size * least(b.whole + m.extra, 3) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN more m ON s.source IS NOT DISTINCT FROM m.source AND s.hash = m.hash
"""

_OP1 = r"""
WITH parsed AS (
  SELECT page_id, url, CAST(1704067200 + ((page_id * 7919) % 527040 + 527040) % 527040 * 60 AS BIGINT) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '@URL@', 1)), '\.+$', ''), '') AS host,
         string_split(regexp_extract(url, '@URL@', 2), '/') AS parts
  FROM pages),
captures AS (
  SELECT *, list_filter(parts, lambda s: length(s) > 0) AS segments FROM parsed),
hosts AS (
  SELECT h, x, 1704067200 + x % 300 * 86400 AS day FROM (
    SELECT DISTINCT host AS h, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS x FROM captures WHERE host IS NOT NULL)
  WHERE x % 5 = 0),
entries(list, effect, kind, pattern, action, day) AS (
  VALUES @ENTRIES@
  UNION ALL SELECT 'hosts', 'block', 'host', h, 'add', day FROM hosts
  UNION ALL SELECT 'hosts', 'block', 'host', h, 'remove', day + 45 * 86400 FROM hosts WHERE x % 2 = 0
  UNION ALL SELECT 'paths', 'allow', 'prefix', h || '/de', 'add', day + 10 * 86400 FROM hosts WHERE x % 3 = 0),
spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, effect, kind, pattern ORDER BY day) AS until FROM entries),
hits AS (
  SELECT c.page_id, s.effect, s.day AS since
  FROM captures c JOIN spans s
    ON s.action = 'add' AND c.fetched >= s.day AND (s.until IS NULL OR c.fetched < s.until)
   AND CASE s.kind WHEN 'host' THEN c.host = s.pattern
            WHEN 'domain' THEN c.host = s.pattern OR suffix(c.host, '.' || s.pattern)
            ELSE starts_with(lower(array_to_string(list_prepend(c.host, c.segments), '/')) || '/', s.pattern || '/') END),
found AS (
  SELECT page_id, count(*) FILTER (effect = 'block') AS n_block, count(*) FILTER (effect = 'allow') AS n_allow,
         min(since) FILTER (effect = 'block') AS blocked, min(since) FILTER (effect = 'allow') AS allowed
  FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, c.host,
       CASE WHEN c.host IS NULL THEN 'invalid' WHEN coalesce(n_allow, 0) > 0 THEN 'allow' WHEN coalesce(n_block, 0) > 0 THEN 'block' ELSE 'none' END AS verdict,
       CAST(coalesce(n_block, 0) AS BIGINT) AS n_block, CAST(coalesce(n_allow, 0) AS BIGINT) AS n_allow,
       CAST(CASE WHEN coalesce(n_allow, 0) > 0 THEN allowed ELSE blocked END AS BIGINT) AS since
FROM captures c LEFT JOIN found f USING (page_id)
"""
_OP1 = _OP1.replace("@URL@", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)")
_OP1 = _OP1.replace("@ENTRIES@", ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', {_YEAR + k * _DAY})" for a, b, c, d, e, k in LIST_ENTRIES))

#: Of rows that repeat an id and text one stays, whichever: they are alike.
_OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filters": _OP1, "op6_mixing": _OP6, "op11_exact_dedup": _OP11}
