"""Queries of answers read by a schema, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from .analogues import read
from .register import query


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders with an answer each, a place for each line: some lack a city, have a text as number, or a key too many.

    By ``o_orderkey % 7``: null, cut off, with a key too many, without places, or as they should be.
    """
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    fields = [
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("name"), F.concat(F.lit("City "), F.col("l_linestatus")).alias("city"), F.lit("").alias("neighborhood"), F.lit("").alias("address"),
        F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('" é')).alias("category"), F.lit("").alias("description"), F.concat(F.lit("@"), F.col("l_suppkey").cast("string")).alias("creator_handle"),
    ]
    sure, kind = F.col("l_discount").alias("confidence"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    text = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    place = F.when(kind == 0, text(fields[0], *fields[2:], sure)).when(kind == 1, text(*fields, F.lit("high").alias("confidence"))).when(kind == 2, text(*fields, sure, F.lit("calm").alias("mood"))).otherwise(text(*fields, sure))
    each = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", place.alias("place")))).alias("places"))
    places = F.concat(F.lit("["), F.array_join("places.place", ", "), F.lit("]"))
    whole = F.concat(F.lit('{"places": '), F.coalesce(places, F.lit("[]")))
    of = F.col("o_orderkey") % 7
    answer = F.when(of == 1, whole).when(of == 2, F.concat(whole, F.lit(', "mood": 1}'))).when(of == 3, F.lit("{}")).when(of > 3, F.concat(whole, F.lit("}")))
    return o.join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", answer.alias("answer"))


_SQL = """WITH lines AS (SELECT *, (l_orderkey + l_linenumber) % 6 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS item FROM lineitem),
rows AS (SELECT o_orderkey, item, CASE WHEN l_returnflag <> 'N' THEN 'Part ' || l_partkey END AS name, CASE WHEN kind <> 0 THEN 'City ' || l_linestatus END AS city, '"' || l_returnflag || '" é' AS category, '@' || l_suppkey AS creator_handle,
CASE WHEN kind <> 1 THEN l_discount END AS confidence, CASE kind WHEN 0 THEN '/places/' || item || '/city: missing' WHEN 1 THEN '/places/' || item || '/confidence: not a number' WHEN 2 THEN '/places/' || item || '/mood: not allowed' ELSE '' END AS violations
FROM orders JOIN lines ON l_orderkey = o_orderkey WHERE o_orderkey % 7 NOT IN (0, 1, 3)),
told AS (SELECT * FROM rows UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, CASE o_orderkey % 7 WHEN 1 THEN ': not JSON' WHEN 2 THEN '/mood: not allowed' ELSE '/places: missing' END FROM orders WHERE o_orderkey % 7 IN (1, 2, 3))"""
_COLUMNS = ["o_orderkey", "item", "name", "city", "category", "creator_handle", "confidence"]


@query(f"{_SQL} SELECT * FROM told")
def extracted_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every answer, and what is wrong with it."""
    return extraction.extracted(_answers(spark, d)).select(*_COLUMNS, F.array_join("violations", "; ").alias("violations"))


@query(f"{_SQL} SELECT {', '.join(_COLUMNS)} FROM rows WHERE o_orderkey NOT IN (SELECT o_orderkey FROM told WHERE violations <> '')")
def extracted_places_strict(spark: SparkSession, d: str) -> DataFrame:
    """Places of answers that are as the schema has them throughout."""
    return extraction.extracted(_answers(spark, d), refuse=True).select(*_COLUMNS)
