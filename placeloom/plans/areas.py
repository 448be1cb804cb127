"""Queries of points in areas, with the SQL that each must equal: every point against every edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas
from ..sources import tables as sources
from .analogues import read
from .register import query

#: Corners about a nation's centre: a star, and a hole in it.
STAR = [(10, 0), (4, 3), (0, 10), (-3, 4), (-10, 0), (-4, -3), (0, -10), (3, -4)]
HOLE = [(1, 1), (1, -1), (-1, -1), (-1, 1)]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Nations as stars in a row around the world, three sizes, the last beyond the date line; their cells, stored."""
    n = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 14.5 - 180).cast("double").alias("x"), (F.col("n_nationkey") * 37 % 100 - 50).cast("double").alias("y"), (F.col("n_nationkey") % 3 + 1).alias("size"))
    west = lambda x: F.when(x >= 180, x - 360).otherwise(x)
    ring = lambda corners: F.array(*[F.struct(west(F.col("x") + a * F.col("size")).alias("x"), (F.col("y") + b * F.col("size")).alias("y")) for a, b in corners])
    folder = sources.scratch_folder(spark, "areas")
    areas.cover(n.select("n_nationkey", F.array(ring(STAR), ring(HOLE)).alias("rings")), "n_nationkey", "rings").write.parquet(folder)
    return spark.read.parquet(folder)


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Lines' orders as points all over the world, on a grid of a hundredth of a degree."""
    place = lambda by, n: (F.col("o_orderkey") * by % n / F.lit(100.0))
    return read(spark, d, "orders").select("o_orderkey", (place(7919, 36000) - 180).alias("longitude"), (place(104729, 16000) - 80).alias("latitude"))


def _corners(corners: list[tuple[int, int]]) -> str:
    after = corners[1:] + corners[:1]
    return ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(corners, after))


_SQL = f"""WITH n AS (SELECT n_nationkey AS area, n_nationkey * 14.5::DOUBLE - 180 AS x, (n_nationkey * 37 % 100 - 50)::DOUBLE AS y, n_nationkey % 3 + 1 AS size FROM nation),
e AS (SELECT area, size, x + a * size + t AS x1, y + b * size AS y1, x + c * size + t AS x2, y + d * size AS y2 FROM n, (VALUES {_corners(STAR)}, {_corners(HOLE)}) AS v(a, b, c, d), (VALUES (0), (-360), (360)) AS w(t)),
p AS (SELECT o_orderkey, o_orderkey * 7919 % 36000 / 100.0::DOUBLE - 180 AS px, o_orderkey * 104729 % 16000 / 100.0::DOUBLE - 80 AS py FROM orders),
hit AS (SELECT o_orderkey, area, any_value(size) AS size FROM p JOIN e ON (y1 <= py) <> (y2 <= py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 WHERE px <> 0 AND py <> 0 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"{_SQL} SELECT o_orderkey AS key, area FROM hit")
def points_in_areas(spark: SparkSession, d: str) -> DataFrame:
    return areas.containing(_points(spark, d), "o_orderkey", _cells(spark, d)).select("key", "area")


@query(f"{_SQL} SELECT o_orderkey AS key, arg_min(area, size * 100 + area) AS area FROM hit GROUP BY o_orderkey")
def neighborhood_by_area(spark: SparkSession, d: str) -> DataFrame:
    """The smallest area about each point."""
    return areas.smallest(areas.containing(_points(spark, d), "o_orderkey", _cells(spark, d)))
