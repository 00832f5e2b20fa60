"""Geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .nulls import _c

# WGS84 ellipsoid and transverse Mercator constants (km).
SEMI_MAJOR = 6378.137
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500.0

_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
# Krueger series to third order.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def add_utm_km(df: DataFrame, lon: str, lat: str, zone: int, x: str = "X", y: str = "Y") -> DataFrame:
    """Easting and northing in km on the northern hemisphere.

    Shared intermediate values are columns of their own, so they are computed once per row.
    """
    keep = df.columns
    s = F.sin(F.radians(lat))
    step = df.withColumns({
        "_t": F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s)),
        "_dl": F.radians(F.col(lon) - F.lit(zone * 6.0 - 183.0))})
    t, dl = F.col("_t"), F.col("_dl")
    step = step.withColumns({
        "_xi": F.atan2(t, F.cos(dl)), "_eta": F.atanh(F.sin(dl) / F.sqrt(1 + t * t))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE * RECTIFYING
    return step.select(*keep, (FALSE_EASTING + k * east).alias(x), (k * north).alias(y))


def valid_lonlat(lon: Column | str, lat: Column | str) -> Column:
    return _c(lon).between(-180.0, 180.0) & _c(lat).between(-90.0, 90.0)


def _on_edge(px: Column, py: Column, e: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return ((cross == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))


def inside_cell(px: Column, py: Column, edges: Column, odd: Column, right: Column, bottom: Column) -> Column:
    """Is a point of a grid cell inside, given the edges through the cell and whether its lower right corner is?

    The way to the corner goes right to the border and then down; an edge that it crosses changes sides. An edge
    on the right border belongs to the next cell, one on the lower border to this cell, as in the corner's own count:
    the way goes a little left of the border, and much less above the position and above the corner. So an edge that meets
    the way down exactly at one of its ends is crossed or not by its slope.
    """
    def crossed(e):
        dx, dy = F.nullif(e["x2"] - e["x1"], F.lit(0.0)), F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), dy)
        across = F.coalesce(((e["y1"] > py) != (e["y2"] > py)) & (px < at) & (at < right), F.lit(False))
        height = e["y1"] + F.try_divide((e["y2"] - e["y1"]) * (right - e["x1"]), dx)
        slope = (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
        on_way = (((height > bottom) | ((height == bottom) & (slope < 0))) & ((height < py) | ((height == py) & (slope >= 0))))
        down = F.coalesce(((e["x1"] >= right) != (e["x2"] >= right)) & on_way, F.lit(False))
        return across != down
    within = F.aggregate(edges, odd, lambda acc, e: acc != crossed(e))
    return within | F.exists(edges, lambda e: _on_edge(px, py, e))


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Do two segments share a point? Touching counts."""
    boxes = ((F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"]))
             & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
             & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"]))
             & (F.least(b["y1"], b["y2"]) <= F.greatest(a["y1"], a["y2"])))
    o1 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    o2 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    o3 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    o4 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    return boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)
