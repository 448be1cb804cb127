"""Queries of containment in JSON documents, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents
from ..sources import tables as sources
from .analogues import read
from .register import query


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw documents: a user, an object of the state, an array of the lines with their flags."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    line = F.struct(F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    lines = li.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    state = F.struct(F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("rank"))
    body = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("user"), state.alias("state"), F.coalesce("lines", F.array()).alias("lines")))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", body.alias("body"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The documents, stored, and their index."""
    folder = sources.scratch_folder(spark, "documents")
    _raw(spark, d).write.parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    documents.write_index(raw, "o_orderkey", "body", folder)
    return raw, folder


@query(
    """SELECT o_orderkey AS doc FROM orders WHERE o_orderstatus = 'F'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 50 = 7 AND l_partkey < 50 AND l_returnflag = 'R')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')"""
)
def json_holding(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold one pattern: an object, and two elements of an array of which one has a part and a flag."""
    raw, folder = _indexed(spark, d)
    pattern = '{"state": {"code": "F"}, "lines": [{"flags": ["O"]}, {"part": 7.0, "flags": ["R"]}]}'
    return documents.holding(spark, folder, raw, "o_orderkey", "body", pattern)


@query(
    """SELECT c_custkey AS pattern, o_orderkey AS doc FROM customer JOIN orders ON o_custkey = c_custkey
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AND l_linestatus = 'F')"""
)
def json_matches(spark: SparkSession, d: str) -> DataFrame:
    """A pattern of each customer against all documents: the user and a line with two flags."""
    raw, folder = _indexed(spark, d)
    c = read(spark, d, "customer")
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("c_custkey") % 3 + 1).cast("int"))
    lines = F.array(F.struct(F.array(F.lit("F"), flag).alias("flags")))
    asked = c.select("c_custkey", F.to_json(F.struct(lines.alias("lines"), F.struct(F.col("c_custkey").alias("id")).alias("user"))).alias("pattern"))
    return documents.matches(spark, folder, raw, "o_orderkey", "body", asked, "c_custkey", "pattern")
