"""Joining positions to areas and working on grids.

Polygons are edge tables (poly_id, ring, seq, x1, y1, x2, y2). For a join they are cut into grid
cells; a cell keeps, per polygon, the edges that pass through it and whether its lower right corner lies inside. The way
from a position to that corner stays in the cell, so its crossings with these edges settle the position. Cells are made
smaller until none holds many edges, so no row grows with a polygon.
A position then needs a single equi-join on its cell, and no shuffle of the positions as long as the
cell table is small enough to be broadcast, which is decided on its written size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..functions.fixed_values import CELL_KM
from ..session import written

EDGE = ("x1", "y1", "x2", "y2")
#: Edges of a polygon that a cell may hold before cells are made smaller.
EDGES_PER_CELL = 256


def rings_to_edges(rings: DataFrame, ids=("poly_id", "ring"), points: str = "pts") -> DataFrame:
    """Edge table from rings given as arrays of (x, y); an open ring is closed."""
    p = F.col(points)
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    shut = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), p).otherwise(
        F.concat(p, F.array(first)))
    closed = rings.select(*ids, shut.alias("_p")).where(F.size("_p") >= 2)
    pair = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.struct(
        i.alias("seq"), F.element_at("_p", i)["x"].alias("x1"), F.element_at("_p", i)["y"].alias("y1"),
        F.element_at("_p", i + 1)["x"].alias("x2"), F.element_at("_p", i + 1)["y"].alias("y2")))
    return closed.select(*ids, F.inline(pair))


def valid_polygons(rings: DataFrame, bad_ids, points: str = "pts") -> DataFrame:
    """Drop known invalid features and rings that cannot bound an area."""
    p = F.col(points)
    a, b = F.element_at(p, 1), F.element_at(p, -1)
    closed = (a["x"] == b["x"]) & (a["y"] == b["y"])
    return rings.where(~F.col("poly_id").isin(list(bad_ids)) & (F.size(p) >= 4) & closed)


def _cell(c, size):
    return F.floor(c / F.lit(size))


def _edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """One row per edge and cell that it passes through: the columns it touches in each of its rows.

    A little is added on both sides against rounding; an edge too many in a cell changes nothing.
    """
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least(y1, y2), cell), _cell(F.greatest(y1, y2), cell))))
    at = lambda y: x1 + F.try_divide((x2 - x1) * (y - y1), y2 - y1)
    low = F.greatest(F.least(y1, y2), F.col("cy") * F.lit(cell))
    high = F.least(F.greatest(y1, y2), (F.col("cy") + 1) * F.lit(cell))
    a, b = F.coalesce(at(low), x1), F.coalesce(at(high), x2)
    slack = F.lit(cell * 1e-6)
    left = F.greatest(F.least(a, b) - slack, F.least(x1, x2))
    right = F.least(F.greatest(a, b) + slack, F.greatest(x1, x2))
    return rows.withColumn("cx", F.explode(F.sequence(_cell(F.least(left, right), cell), _cell(F.greatest(left, right), cell))))


def _corner_parity(edges: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, poly_id, odd): cells whose lower right corner has an odd number of edges to its right.

    An edge meets the lines between rows that it spans; meetings in one cell of a line are reduced to their parity before
    each of them is carried to the cells on its left.
    """
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    box = edges.groupBy("poly_id").agg(F.min(F.least("x1", "x2")).alias("_left"))
    first, last = F.ceil(F.least(y1, y2) / cell), F.ceil(F.greatest(y1, y2) / cell) - 1
    met = (edges.where(last >= first).withColumn("cy", F.explode(F.sequence(first, last)))
           .withColumn("_at", x1 + (x2 - x1) * (F.col("cy") * F.lit(cell) - y1) / (y2 - y1)))
    odd = (met.groupBy("poly_id", "cy", _cell(F.col("_at"), cell).alias("_c")).agg(F.count("*").alias("_n"))
           .where("_n % 2 = 1").join(box, "poly_id"))
    reach = odd.withColumn("_first", _cell(F.col("_left"), cell)).where("_c - 1 >= _first")
    return (reach.withColumn("cx", F.explode(F.sequence(F.col("_first"), F.col("_c") - 1)))
            .groupBy("cx", "cy", "poly_id").agg((F.count("*") % 2 == 1).alias("odd")))


def polygon_cells(edges: DataFrame, cell: float, most: int = EDGES_PER_CELL) -> tuple[DataFrame, float]:
    """(cx, cy, poly_id, edges, odd) of the cells that a polygon covers or touches, and the size of the cells.

    Written out, so that later joins know its size. Cells are halved until none holds more than ``most`` edges of a polygon, or
    until that does not help (edges that meet in one point).
    """
    before = None
    while True:
        through = _edge_cells(edges, cell).select("cx", "cy", "poly_id", F.struct(*EDGE).alias("e"), F.lit(False).alias("odd"))
        corners = _corner_parity(edges, cell).select("cx", "cy", "poly_id", F.lit(None).cast(through.schema["e"].dataType).alias("e"), "odd")
        count = through.groupBy("cx", "cy", "poly_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if count <= most or count == before:
            per = through.unionByName(corners).groupBy("cx", "cy", "poly_id").agg(F.collect_list("e").alias("edges"), F.bool_or("odd").alias("odd"))
            return written(per.where("odd OR size(edges) > 0"), "polygon_cells"), cell
        cell, before = cell / 2, count


def _binned(points: DataFrame, lon: str, lat: str, cell: float) -> DataFrame:
    return points.withColumns({"_cx": _cell(F.col(lon), cell), "_cy": _cell(F.col(lat), cell)})


def point_in_polygon(points: DataFrame, edges: DataFrame, lon: str, lat: str, cell: float = 1.0,
                     name: str = "area", how: str = "left") -> DataFrame:
    """Attach the polygons that contain each point, borders included.

    ``left`` keeps points outside every polygon with NULL; a point on a shared border gets one row
    per polygon. One equi-join on the grid cell, with the geometry in its condition, serves any number
    of polygons per cell.
    """
    cells, cell = polygon_cells(edges, cell)
    c = cells.select("cx", "cy", F.col("poly_id").alias(name), F.col("edges").alias("_edges"), F.col("odd").alias("_odd"))
    near = _binned(points, lon, lat, cell)
    within = ((F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy"))
              & geo.inside_cell(F.col(lon), F.col(lat), F.col("_edges"), F.col("_odd"), (F.col("cx") + 1) * F.lit(cell), F.col("cy") * F.lit(cell)))
    kept = [x for x in points.columns if x != name]
    near = near.select(*kept, "_cx", "_cy")
    return near.join(c, within, how).select(*kept, name)


def polygon_overlap(a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs (a_id, b_id) of polygons that share a point.

    Two polygons overlap if edges meet, found among the edges that fall in the same cell, or if one
    lies inside the other, found by placing one vertex of each ring.
    """
    def binned(df, p):
        return (_edge_cells(df, cell)
                .select("cx", "cy", F.col("poly_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in EDGE]))

    def seg(p):
        return {c: F.col(f"{p}_{c}") for c in EDGE}

    meets = (binned(a, "a").join(written(binned(b, "b"), "edge_cells"), ["cx", "cy"])
             .where(geo.segments_meet(seg("a"), seg("b"))).select("a_id", "b_id").distinct())

    def nested(outer, inner, inner_name, outer_name):
        start = inner.where("seq = 1").select(F.col("poly_id").alias(inner_name), "x1", "y1")
        return point_in_polygon(start, outer, "x1", "y1", cell, outer_name, "inner").select("a_id", "b_id")

    return meets.union(nested(b, a, "a_id", "b_id")).union(nested(a, b, "b_id", "a_id")).distinct()


def overlap_join(ids: DataFrame, a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """Every polygon of ``ids`` (column a_id) with the polygons it overlaps, NULL when none."""
    return ids.join(polygon_overlap(a, b, cell), "a_id", "left")


def add_utm(df: DataFrame, lon: str, lat: str, zone: int = 19) -> DataFrame:
    return geo.add_utm_km(df, lon, lat, zone)


def _extent(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


def _cells_along(lo, hi, size):
    return F.greatest(F.ceil((hi - lo) / size), F.lit(1))


def grid_centers(df: DataFrame, x: str = "X", y: str = "Y", size: float = CELL_KM) -> DataFrame:
    """Regular grid over the extent of the points: (gx, gy, X, Y), centres of the cells."""
    ext = _extent(df, x, y)
    col = ext.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), _cells_along(F.col("x0"), F.col("x1"), size) - 1)).alias("gx"))
    # one row so far: spread the columns of the grid before growing each to its full height
    col = col.repartition("gx")
    full = col.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), _cells_along(F.col("y0"), F.col("y1"), size) - 1)).alias("gy"))
    return full.select("gx", "gy", (F.col("x0") + (F.col("gx") + 0.5) * size).alias("X"),
                       (F.col("y0") + (F.col("gy") + 0.5) * size).alias("Y"))


def grid_near_points(df: DataFrame, x: str = "X", y: str = "Y", size: float = CELL_KM) -> DataFrame:
    """Grid centres within one cell width of any point.

    Each point names the centres of its 3 x 3 neighbourhood it reaches; duplicates vanish in the
    map-side distinct, so a crowded cell costs one scan of its points and no join.
    """
    ext = _extent(df, x, y)
    x0, x1, y0, y1 = (ext.select(c).scalar() for c in ("x0", "x1", "y0", "y1"))
    off = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = (df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), x0.alias("_x0"), y0.alias("_y0"),
                      _cells_along(x0, x1, size).alias("_nx"), _cells_along(y0, y1, size).alias("_ny"))
            .withColumn("_dx", off).withColumn("_dy", off)
            .withColumn("gx", F.floor((F.col("_x") - F.col("_x0")) / size) + F.col("_dx"))
            .withColumn("gy", F.floor((F.col("_y") - F.col("_y0")) / size) + F.col("_dy"))
            .withColumn("X", F.col("_x0") + (F.col("gx") + 0.5) * size)
            .withColumn("Y", F.col("_y0") + (F.col("gy") + 0.5) * size))
    dx, dy = F.col("X") - F.col("_x"), F.col("Y") - F.col("_y")
    return (near.where((dx * dx + dy * dy <= size * size) & F.col("gx").between(0, F.col("_nx") - 1)
                       & F.col("gy").between(0, F.col("_ny") - 1))
            .select("gx", "gy", "X", "Y").distinct())


def crop_edges(edges: DataFrame, extent: DataFrame) -> DataFrame:
    """Whole edges whose box meets the extent (one row xmin, ymin, xmax, ymax)."""
    e = {c: extent.select(c).scalar() for c in ("xmin", "ymin", "xmax", "ymax")}
    return edges.where((F.greatest("x1", "x2") >= e["xmin"]) & (F.least("x1", "x2") <= e["xmax"])
                       & (F.greatest("y1", "y2") >= e["ymin"]) & (F.least("y1", "y2") <= e["ymax"]))


def mesh_cell(df: DataFrame, cutoff: float = 30.0, x: str = "X", y: str = "Y") -> DataFrame:
    """Coarse spatial support: the cell each position falls in."""
    return df.withColumns({"mx": F.floor(F.col(x) / cutoff), "my": F.floor(F.col(y) / cutoff)})


def area_weighted_index(df: DataFrame, year: str, est: str, cell_area: float) -> DataFrame:
    return df.groupBy(year).agg(F.sum(F.col(est) * cell_area).alias("index"))


def center_of_gravity(df: DataFrame, year: str, est: str, x: str = "X", y: str = "Y") -> DataFrame:
    """Mean position weighted by the estimate, one row per year and coordinate."""
    w = F.col(est)
    g = df.groupBy(year).agg(*[F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(n) for c, n in ((x, "X"), (y, "Y"))])
    return g.unpivot([year], ["X", "Y"], "coord", "est")
