"""Which areas points lie in: polygons are covered by cells that fit them, and points meet the cells by equality.

An area is an array of rings of ``x`` (longitude) and ``y`` (latitude); a point is inside if a ray to the east
crosses its rings an odd number of times, so further rings are holes or islands, in any direction
and closed or not. Edges go the short way round, so a ring may cross the date line; a ring around a
pole raises ValueError. A cell wholly inside is no more than a key. A cell with a border is split
until few edges lie in it or end east of it at its height; these go with the cell, and with the count of those
that pass it, and are all that a point in it is compared with, by the arithmetic of the whole area.

Coordinates that are null, NaN or 0 count as missing, as in ``enrich.reverse_geocode``; such points lie nowhere,
nor do points in areas that are null or have rings of fewer than three corners only. Areas of one id are one area.
Points of one key are each looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Degrees of the largest cells, a quarter of which are the next ones; levels of cells; edges that end the splitting.
LARGEST, LEVELS, EDGES = 16.0, 7, 16


def _side(level: int) -> float:
    return LARGEST / 4**level


def edges_of(rings: list[list[dict[str, float]] | None] | None) -> np.ndarray:
    """Edges ``x1, y1, x2, y2`` of rings, the short way round."""
    out, first = [], 0.0
    for ring in rings or []:
        at = np.array([(p["x"], p["y"]) for p in ring or [] if p and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
        if len(at) < 3:
            continue
        step = np.diff(np.append(at[:, 0], at[0, 0]))
        turns = np.round(step / 360.0)
        if turns.sum():
            raise ValueError("a ring goes around a pole")
        x = at[:, 0] - 360.0 * np.append(0.0, np.cumsum(turns[:-1]))
        middle = (x.min() + x.max()) / 2
        x = x + 360.0 * np.round(((first if out else middle) - middle) / 360.0)  # rings of an area lie on one side of the date line
        first = first if out else middle
        out.append(np.column_stack([x, at[:, 1], np.roll(x, -1), np.roll(at[:, 1], -1)]))
    return np.concatenate(out) if out else np.empty((0, 4))


def _cuts(edges: np.ndarray, x: float, y: float, side: float) -> bool:
    """Whether an edge may touch a cell."""
    x1, y1, x2, y2 = edges.T
    near = edges[(np.maximum(x1, x2) >= x) & (np.minimum(x1, x2) <= x + side) & (np.maximum(y1, y2) >= y) & (np.minimum(y1, y2) <= y + side)]
    if not len(near):
        return False
    x1, y1, x2, y2 = near.T
    corners = np.array([(x2 - x1) * (b - y1) - (y2 - y1) * (a - x1) for a in (x, x + side) for b in (y, y + side)])
    margin = 1e-9 * (1 + np.abs(x2 - x1) + np.abs(y2 - y1))
    return bool((~((corners.min(0) > margin) | (corners.max(0) < -margin))).any())


def _crossed(edges: np.ndarray, x: float, y: float) -> int:
    e = edges[(edges[:, 1] <= y) != (edges[:, 3] <= y)]
    return int((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum())


def cells_of(edges: np.ndarray) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """Level and place of the cells that an area has part in, whether a point is inside before its crossings are counted, and the edges to count."""
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    reach = [range(int(np.floor(v.min() / LARGEST)), int(np.floor(v.max() / LARGEST)) + 1) for v in (xs, ys)]
    left = [(0, a, b, edges, 0) for a in reach[0] for b in reach[1]]
    while left:
        level, a, b, near, odd = left.pop()
        side = _side(level)
        x, y = a * side, b * side
        low, high = np.minimum(near[:, 1], near[:, 3]), np.maximum(near[:, 1], near[:, 3])
        kept = (high >= y) & (low <= y + side) & (np.maximum(near[:, 0], near[:, 2]) >= x)
        # edges east of the cell that pass its whole height are crossed by every ray
        passed = kept & (np.minimum(near[:, 0], near[:, 2]) > x + side + 1e-9) & (low <= y) & (high >= y + side)
        near, odd = near[kept & ~passed], (odd + int(passed.sum())) % 2
        if not _cuts(near, x, y, side):
            if (odd + _crossed(near, x + side / 2, y + side / 2)) % 2:
                yield level, a, b, True, near[:0]
        elif level == LEVELS - 1 or len(near) <= EDGES:
            yield level, a, b, odd == 1, near
        else:
            left += [(level + 1, 4 * a + i, 4 * b + j, near, odd) for i in range(4) for j in range(4)]


def cover(areas: DataFrame, id_col: str, rings: str) -> DataFrame:
    """``area, extent, level, cx, cy, inside, edges``: the cells of areas, which those beyond the date line have on its other side too."""
    edge = "struct<x1:double,y1:double,x2:double,y2:double>"
    kept = areas.select(F.col(id_col).alias("area"), F.col(rings).alias("rings")).where("rings IS NOT NULL")
    schema = T.StructType([kept.schema["area"], *T._parse_datatype_string(f"extent double, level int, cx long, cy long, inside boolean, edges array<{edge}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")]))]
        names = ["extent", "level", "cx", "cy", "inside", "edges"]
        for batch in batches:
            for k, rings_of in enumerate(batch.column(1)):
                edges = edges_of(rings_of.as_py())
                if not len(edges):
                    continue
                extent = float(abs((edges[:, 0] * edges[:, 3] - edges[:, 2] * edges[:, 1]).sum()) / 2)
                for turn in (0.0, -360.0, 360.0):
                    moved = edges + np.array([turn, 0.0, turn, 0.0])
                    if moved[:, 0].max() < -180 or moved[:, 0].min() > 180:
                        continue
                    found = [{"extent": extent, "level": level, "cx": a, "cy": b, "inside": inside, "edges": [dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in near]} for level, a, b, inside, near in cells_of(moved)]
                    if found:
                        rows = pa.Table.from_pylist(found, schema=pa.schema(list(zip(names, kinds)))).to_batches()[0]
                        area = batch.column(0).take(pa.array([k] * len(found)))
                        yield pa.RecordBatch.from_arrays([area, *rows.columns], names=["area", *names])

    return kept.mapInArrow(run, schema)


def _inside(x: Column, y: Column) -> Column:
    """Whether a point is inside by the edges of its cell."""
    crossed = F.filter("edges", lambda e: ((e["y1"] <= y) != (e["y2"] <= y)) & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]))
    return (F.col("inside").cast("int") + F.size(crossed)) % 2 == 1


def containing(points: DataFrame, key: str, cells: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """``key, area, extent``: each point with every area that it lies in. ``cells`` is a stored ``cover``.

    Longitudes may go beyond 180 degrees. A point is looked up once for each level of cells (seven at most), as a narrow row.
    """
    far = F.col(longitude).cast("double")
    x = F.when((far >= -180) & (far < 180), far).otherwise(far - 360 * F.floor((far + 180) / 360)).alias("x")
    at = points.select(F.col(key).alias("key"), x, F.col(latitude).cast("double").alias("y")).where("x <> 0 AND y <> 0 AND NOT isnan(x) AND NOT isnan(y)")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / _side(k)).alias("cx"), F.floor(F.col("y") / _side(k)).alias("cy")) for k in range(LEVELS)])
    looked = at.select("key", "x", "y", F.explode(levels).alias("cell")).select("key", "x", "y", "cell.*")
    return looked.join(cells, ["level", "cx", "cy"]).where(_inside(F.col("x"), F.col("y"))).select("key", "area", "extent")


def smallest(found: DataFrame) -> DataFrame:
    """``key, area`` of the smallest area that a point lies in; of areas as large the least id."""
    return found.groupBy("key").agg(F.min(F.struct("extent", "area"))["area"].alias("area"))
