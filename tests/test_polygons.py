"""Positions in polygons against the even-odd rule over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.operators import spatial as G

RNG = np.random.default_rng(12)


def _star(n, cx, cy, low, high):
    turn = np.sort(RNG.uniform(0, 2 * np.pi, n))
    reach = RNG.uniform(low, high, n)
    return np.stack([cx + reach * np.cos(turn), cy + reach * np.sin(turn)], axis=1)


def _edges(k, ring):
    return [(k, 0, i + 1, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(ring, np.roll(ring, -1, axis=0)))]


def _inside(edges, x, y):
    odd = False
    for *_, x1, y1, x2, y2 in edges:
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


SCHEMA = "poly_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("most", [256, 3])
def test_polygons_equal_even_odd_rule(spark, monkeypatch, most):
    monkeypatch.setattr(G.polygon_cells, "__defaults__", (most,))
    polygons = {1: _edges(1, _star(60, 0.3, 0.2, 0.5, 4)), 2: _edges(2, _star(9, -3, 2, 1, 3)), 3: _edges(3, np.array([[0, 0], [2, 0], [2, 2], [0, 2]])),
                4: _edges(4, np.array([[-1, -1], [0.5, -1], [0.5, 0.5], [1.5, 0.5], [1.5, 3], [-1, 3]])), 5: _edges(5, np.array([[10, 10], [11, 10.5], [10.25, 11]]))}
    # a hole and a ring that crosses itself
    polygons[6] = _edges(6, np.array([[-5, -5], [5, -5], [5, 5], [-5, 5]])) + _edges(6, np.array([[-1.5, -1.5], [1.5, -1.5], [1.5, 1.5], [-1.5, 1.5]]))
    polygons[7] = _edges(7, np.array([[0, 0], [4, 4], [4, 0], [0, 4]]))
    points = [(float(x), float(y)) for x, y in RNG.uniform(-6, 6, (300, 2))] + [(a / 2, b / 2) for a in range(-12, 13) for b in range(-12, 13)] + [(10.3, 10.4)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lon double, lat double")
    edges = spark.createDataFrame([e for es in polygons.values() for e in es], SCHEMA)
    got = {}
    for r in G.point_in_polygon(df, edges, "lon", "lat").collect():
        got.setdefault(r.id, set()).add(r.area)
    for i, (x, y) in enumerate(points):
        want = {k for k, es in polygons.items() if _inside(es, x, y)} or {None}
        assert got[i] == want, (x, y)


def test_polygon_of_many_edges(spark):
    n = 100_000
    turn = 2 * np.pi * np.arange(n) / n
    ring = np.stack([3 * np.cos(turn) * (1 + 0.1 * np.sin(50 * turn)), 3 * np.sin(turn) * (1 + 0.1 * np.sin(50 * turn))], axis=1)
    edges = spark.createDataFrame(_edges(1, ring), SCHEMA).repartition(8)
    cells, size = G.polygon_cells(edges, 1.0)
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= G.EDGES_PER_CELL and size < 1
    points = RNG.uniform(-4, 4, (500, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r.id: r.area for r in G.point_in_polygon(df, edges, "lon", "lat").collect()}
    for i, (x, y) in enumerate(points):
        r, t = np.hypot(x, y), np.arctan2(y, x)
        edge = 3 * (1 + 0.1 * np.sin(50 * t))
        if abs(r - edge) > 1e-4:
            assert (got[i] == 1) == (r < edge)
