"""Points in areas against a test of every point with every edge."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from placeloom.operators import areas

RINGS = "id string, rings array<array<struct<x:double,y:double>>>"


def _ring(rng, x, y, r, n):
    return [(x + (a := r * rng.uniform(0.9, 1)) * math.cos(2 * math.pi * k / n), y + a * math.sin(2 * math.pi * k / n)) for k in range(n)]


def _inside(rings, x, y):
    """The rule, edge by edge."""
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n += (y1 <= y) != (y2 <= y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


@pytest.fixture(scope="module")
def world():
    rng = random.Random(8)
    out = {f"a{k}": [_ring(rng, x := rng.uniform(-120, 120), y := rng.uniform(-50, 50), r := rng.choice([0.01, 0.5, 8, 40]), rng.choice([3, 8, 300])), _ring(rng, x, y, r / 5, 6)] for k in range(15)}
    out["square"] = [[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0)], [(12.0, 12.0), (16.0, 12.0), (16.0, 16.0), (12.0, 16.0)]]
    out["date line"] = [_ring(rng, 179.0, 5.0, 9, 200), _ring(rng, 178.0, 5.0, 1.5, 6)]
    return out


def _points(rng, world):
    out = [(rng.uniform(-180, 180), rng.uniform(-70, 70)) for _ in range(1500)]
    for rings in world.values():
        xs, ys = [[p[k] for r in rings for p in r] for k in (0, 1)]
        out += [(rng.uniform(min(xs), max(xs)), rng.uniform(min(ys), max(ys))) for _ in range(150)] + rings[0][:20]  # corners too
    return out + [(10.0, 15.0), (20.0, 15.0), (16.0, 16.0), (12.0, 12.0), (16.0, 10.0), (15.0, 20.0)]


def _west(x):
    return x - 360 if x >= 180 else x


def test_against_all_edges(spark, world):
    rng = random.Random(9)
    points = _points(rng, world)
    rows = [(k, [[(_west(x), y) for x, y in r] for r in rings]) for k, rings in world.items()]
    table = spark.createDataFrame([*rows, ("none", None), ("empty", []), ("line", [[(1.0, 1.0), (5.0, 5.0)], None])], RINGS)
    at = [(k, *p) for k, p in enumerate(points)] + [(-1, None, 5.0), (-2, 15.0, float("nan")), (-3, 0.0, 5.0), (-4, 15.0, None)]
    found = areas.containing(spark.createDataFrame(at, "n long, longitude double, latitude double"), "n", areas.cover(table, "id", "rings")).collect()
    date = {"date line": [[(_west(x), y) for x, y in world["date line"][0]]]}
    assert any(a[0] - b[0] > 300 for a, b in zip(date["date line"][0], date["date line"][0][1:]))
    want = set()
    for k, (x, y) in enumerate(points):
        for name, rings in world.items():
            turns = (0, 360) if name == "date line" else (0,)
            want |= {(k, name) for t in turns if _inside(rings, _west(x) + t, y)}
    got = [(r["key"], r["area"]) for r in found]
    near = {k for k, (x, y) in enumerate(points) if any((x, y) in r for r in world["date line"])}  # corners that were moved by 360 degrees are rounded
    assert len(got) == len(set(got)) and {p for p in got if p[0] not in near} == {p for p in want if p[0] not in near} and len(want) > 1200


def test_cells_fit_their_area():
    ring = _ring(random.Random(1), 30.0, 20.0, 35, 500)
    cells = list(areas.cells_of(areas.edges_of([[{"x": x, "y": y} for x, y in ring]])))
    inner = sum(areas._side(level) ** 2 for level, _, _, _, near in cells if not len(near))
    border = sum(areas._side(level) ** 2 for level, _, _, _, near in cells if len(near))
    e = areas.edges_of([[{"x": x, "y": y} for x, y in ring]])
    extent = abs((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum()) / 2
    assert inner < extent < inner + border and len(cells) < 20_000
    assert all(len(near) <= areas.EDGES for level, _, _, _, near in cells if level < areas.LEVELS - 1)


def test_poles_smallest_and_empty(spark):
    with pytest.raises(ValueError):
        areas.edges_of([[{"x": x, "y": 80.0} for x in (0.0, 120.0, -120.0)]])
    square = lambda a: [[(a, a), (-a, a), (-a, -a), (a, -a)]]
    table = spark.createDataFrame([("wide", square(50.0)), ("b", square(5.0)), ("a", square(5.0))], RINGS)
    cells = areas.cover(table, "id", "rings")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 369.0, 9.0), (3, 70.0, 1.0)], "n long, longitude double, latitude double")
    assert {r["key"]: r["area"] for r in areas.smallest(areas.containing(points, "n", cells)).collect()} == {1: "a", 2: "wide"}
    assert areas.containing(points, "n", areas.cover(table.where("false"), "id", "rings")).count() == areas.containing(points.where("false"), "n", cells).count() == 0
