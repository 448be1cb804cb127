"""Queries of full-text search and deep pages, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import paging, search
from ..sources import tables as sources
from .analogues import read
from .register import query


def stem_sql(word: str) -> str:
    """The stemmer's steps as SQL over lists of one word."""
    out = f"[{word}]"
    for k, step in enumerate(search.STEPS):
        cases = []
        for s in step:
            tail = f"'{s.put}'" if isinstance(s.put, str) else "CASE regexp_extract(w, '" + s.pattern + "', 2) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in s.put.items()) + " END"
            unless = f" AND NOT regexp_matches(w, '{s.unless}')" if s.unless else ""
            cases.append(f"WHEN regexp_matches(w, '{s.pattern}'){unless} THEN regexp_extract(w, '{s.pattern}', 1) || {tail}")
        out = f"list_transform({out}, lambda w: CASE {' '.join(cases)} ELSE w END)"
    return f"CASE WHEN regexp_matches({word}, '^[a-z]{{3,}}$') THEN ({out})[1] ELSE {word} END"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Words of documents by place, stemmed: what every search in SQL begins with.
_WORDS = f"""spread AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ws FROM documents),
said AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM spread),
stems AS (SELECT word, {stem_sql("word")} AS term FROM (SELECT DISTINCT word FROM said WHERE word NOT IN ({_STOPS})))"""


@query(f"WITH {_WORDS} SELECT term, doc_id AS doc, array_to_string(list(place ORDER BY place), ',') AS positions FROM said JOIN stems USING (word) GROUP BY ALL")
def text_postings(spark: SparkSession, d: str) -> DataFrame:
    found = search.postings(read(spark, d, "documents"), "doc_id", "text")
    return found.select("term", "doc", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _term(word: str) -> str:
    return f"(SELECT {stem_sql(f"'{word}'")})"


@query(
    f"""WITH {_WORDS},
terms AS (SELECT term, doc_id, count(*) AS f, list(place) AS at FROM said JOIN stems USING (word) GROUP BY ALL),
asked AS (SELECT unnest([{", ".join(_term(w) for w in ("th", "thing"))}]) AS term),
n AS (SELECT term, count(*) AS df FROM terms JOIN asked USING (term) GROUP BY term),
hits AS (SELECT doc_id, count(*) AS met, sum(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df) * f / (f + 1)) AS rank FROM terms JOIN n USING (term) GROUP BY doc_id),
rest AS (SELECT DISTINCT doc_id FROM terms WHERE term = {_term("ouing")})
SELECT doc_id AS doc, round(rank, 6) AS rank FROM hits WHERE met >= 1 AND doc_id NOT IN (SELECT doc_id FROM rest)"""
)
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one of two words and without a third, ranked."""
    docs = read(spark, d, "documents")
    folder = sources.scratch_folder(spark, "postings")
    search.write_postings(search.spread(docs, "doc_id", "text"), folder)
    found = search.search(spark, folder, search.Query(any_of=["th", "thing"], none_of=["ouing"]), docs.count())
    return found.select("doc", F.round("rank", 6).alias("rank"))


@query(
    f"""WITH {_WORDS},
a AS (SELECT DISTINCT s.doc_id FROM said s JOIN said t ON s.doc_id = t.doc_id AND t.place = s.place + 2 JOIN stems x ON x.word = s.word JOIN stems y ON y.word = t.word WHERE x.term = {_term("er")} AND y.term = {_term("ed")}),
b AS (SELECT DISTINCT doc_id FROM said JOIN stems USING (word) WHERE term = {_term("re")})
SELECT doc_id AS doc FROM a SEMI JOIN b USING (doc_id)"""
)
def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase, two words with a stop word between them, and with another word."""
    docs = read(spark, d, "documents")
    folder = sources.scratch_folder(spark, "phrases")
    search.write_postings(search.spread(docs, "doc_id", "text"), folder)
    return search.search(spark, folder, search.Query(all_of=["re"], phrases=["er the ed"]), docs.count()).select("doc")


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem
ORDER BY l_returnflag DESC NULLS FIRST, l_extendedprice NULLS LAST, l_orderkey NULLS LAST, l_linenumber NULLS LAST LIMIT 100 OFFSET (SELECT count(*) * 2 // 3 // 100 * 100 FROM lineitem)"""
)
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """The page two thirds through all lines, by the return flag downwards and the price upwards."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    page = paging.Page(100, li.count() * 2 // 3 // 100 + 1)
    return paging.deep_page(li, [("l_returnflag", False), ("l_extendedprice", True), ("l_orderkey", True), ("l_linenumber", True)], page, most=2000, buckets=64)
