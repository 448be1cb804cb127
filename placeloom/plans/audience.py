"""Queries of who may see and write rows, for all users at once, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audience
from . import analogues as a
from .analogues import read
from .register import query

#: The rules as they are said of one user, asked for every user.
_SQL = f"""WITH {a.SHARING_SQL}, users AS (SELECT user_id AS u FROM lists UNION SELECT user_id FROM list_collaborators),
seen AS (SELECT l.id, u FROM lists l, users WHERE l.user_id = u UNION SELECT l.id, u FROM users JOIN list_collaborators c ON c.user_id = u JOIN lists l ON l.id = c.list_id)"""


@query(f"{_SQL} SELECT id, 'all' AS audience, NULL::BIGINT AS reader FROM lists WHERE is_public UNION ALL SELECT id, 'user', u FROM seen WHERE id NOT IN (SELECT id FROM lists WHERE is_public)")
def rls_lists_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Each list with everyone who may see it."""
    return audience.readers("lists", a.sharing(spark, d)).select("id", "audience", "reader")


@query(
    f"""{_SQL} SELECT list_id, place_id, 'all' AS audience, NULL::BIGINT AS reader FROM list_places WHERE list_id IN (SELECT id FROM lists WHERE is_public)
UNION ALL SELECT list_id, place_id, 'user', u FROM list_places JOIN seen ON id = list_id WHERE list_id NOT IN (SELECT id FROM lists WHERE is_public)"""
)
def rls_list_places_of_all(spark: SparkSession, d: str) -> DataFrame:
    return audience.readers("list_places", a.sharing(spark, d)).select("list_id", "place_id", "audience", "reader")


@query(f"{_SQL} SELECT list_id, c.user_id, role, 'user' AS audience, u AS reader FROM list_collaborators c, users WHERE u = c.user_id UNION SELECT list_id, c.user_id, role, 'user', u FROM list_collaborators c JOIN lists l ON l.id = list_id JOIN users ON u = l.user_id")
def rls_collaborators_of_all(spark: SparkSession, d: str) -> DataFrame:
    return audience.readers("list_collaborators", a.sharing(spark, d)).select("list_id", "user_id", "role", "audience", "reader")


@query(
    f"""{_SQL} SELECT list_id, place_id, 'user' AS audience, u AS reader FROM list_places p JOIN lists l ON l.id = list_id JOIN users ON u = l.user_id
UNION SELECT p.list_id, place_id, 'user', u FROM list_places p JOIN list_collaborators c ON c.list_id = p.list_id AND role = 'editor' JOIN users ON u = c.user_id"""
)
def rls_list_places_writers(spark: SparkSession, d: str) -> DataFrame:
    tables = a.sharing(spark, d)
    return audience.writers("list_places", "insert", tables["list_places"], tables).select("list_id", "place_id", "audience", "reader")


@query(
    f"""{_SQL}, shown AS (SELECT p.list_id, place_id, u FROM list_places p JOIN seen ON id = p.list_id WHERE p.list_id NOT IN (SELECT id FROM lists WHERE is_public))
SELECT c_custkey AS reader, (SELECT count(*) FROM list_places WHERE list_id IN (SELECT id FROM lists WHERE is_public)) + coalesce(n, 0) AS "rows" FROM customer LEFT JOIN (SELECT u, count(*) AS n FROM shown GROUP BY u) ON u = c_custkey"""
)
def rls_reach_of_all(spark: SparkSession, d: str) -> DataFrame:
    """How many listed places each customer may see."""
    return audience.reach(audience.readers("list_places", a.sharing(spark, d)), read(spark, d, "customer"), "c_custkey").select("reader", F.col("rows"))
