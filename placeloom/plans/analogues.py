"""The test tables in the shape of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places: the brand is the neighborhood and, by its number, the city."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("neighborhood"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("city"), F.col("p_retailprice").alias("created_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles; every seventh has no display name."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise("").alias("display_name"), F.col("c_mktsegment").alias("phone"))


PROFILES_SQL = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS display_name, c_mktsegment AS phone FROM customer"


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered parts as saved places, saved when last ordered."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    joined = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("place_id")).agg(F.max("o_orderdate").alias("created_at"))


SAVED_SQL = "SELECT o_custkey AS user_id, l_partkey AS place_id, max(o_orderdate) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


def sharing(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as lists (finished ones are public), suppliers of their lines as collaborators, lines as listed places."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    lists = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("is_public"), F.col("o_orderdate").alias("created_at"))
    helpers = li.select(F.col("l_orderkey").alias("list_id"), F.col("l_suppkey").alias("user_id"), F.when(F.col("l_returnflag") == "R", "editor").otherwise("viewer").alias("role")).distinct()
    listed = li.select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("place_id")).distinct()
    guides = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("slug"), (F.col("o_orderstatus") == "O").alias("is_published"))
    return {"lists": lists, "list_collaborators": helpers, "list_places": listed, "guides": guides}


SHARING_SQL = """lists AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS title, o_orderstatus = 'F' AS is_public, o_orderdate AS created_at FROM orders),
list_collaborators AS (SELECT DISTINCT l_orderkey AS list_id, l_suppkey AS user_id, CASE WHEN l_returnflag = 'R' THEN 'editor' ELSE 'viewer' END AS role FROM lineitem),
list_places AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS place_id FROM lineitem)"""
