"""Queries on positions, areas and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.fixed_values import CELL_AREA
from ..operators import aggregates as A, spatial as G
from ..operators.reshape import pivot_values
from ..session import scratch_path
from .base import TOWS_SQL, TRAITS_SQL, query, r, rnd, table
from .community import CWM_SQL, tow_cwm

# ---- positions: the first two embedding entries as longitude and latitude -------------------

POS_SQL = """pos AS (SELECT vec_id, -70 + 10 * CAST(embedding[1] AS DOUBLE) AS lon,
  40 + 10 * CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)"""


def positions(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", (-70 + 10 * F.get(e, F.lit(0)).cast("double")).alias("lon"),
        (40 + 10 * F.get(e, F.lit(1)).cast("double")).alias("lat"))


# ---- areas: a lattice of quadrilaterals, one per nation, some with a hole -------------------
# Neighbours share their bent borders. The expressions are valid in both engines.

BAD_AREA = 24


def _corner(i: str, j: str) -> tuple[str, str]:
    return (f"(-74e0 + 1.6e0 * {i} + 0.25e0 * (({i} * 7 + {j} * 3) % 3 - 1))",
            f"(36e0 + 1.6e0 * {j} + 0.2e0 * (({i} * 5 + {j} * 2) % 3 - 1))")


_OUTER = [_corner(i, j) for i, j in (("i", "j"), ("(i + 1)", "j"), ("(i + 1)", "(j + 1)"), ("i", "(j + 1)"), ("i", "j"))]
_MID = ("(-73.2e0 + 1.6e0 * i)", "(36.8e0 + 1.6e0 * j)")
_HOLE = [(f"({_MID[0]} + {dx}e0)", f"({_MID[1]} + {dy}e0)")
         for dx, dy in ((-0.3, -0.3), (0.3, -0.3), (0.3, 0.3), (-0.3, 0.3), (-0.3, -0.3))]
_I, _J = "n_nationkey % 5", "CAST(floor(n_nationkey / 5e0) AS INTEGER)"


_LAYERS: dict[tuple[str, str], str] = {}


def area_rings(spark, sf):
    """The stored area layer of a session: closed rings counted from the south-west corner."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _LAYERS:
        _LAYERS[at] = scratch_path(spark, "area_rings")
        _build_rings(spark, sf).write.parquet(_LAYERS[at])
    return spark.read.schema("poly_id int, ring int, pts array<struct<x:double,y:double>>").parquet(_LAYERS[at])


def _build_rings(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_nationkey AS poly_id", f"{_I} AS i", f"{_J} AS j")
    x, y = _corner("(i + if(k IN (1, 2), 1, 0))", "(j + if(k IN (2, 3), 1, 0))")
    side, up = "if(k IN (1, 2), 0.3e0, -0.3e0)", "if(k IN (2, 3), 0.3e0, -0.3e0)"

    def ring(px, py):
        return f"transform(sequence(0, 4), k -> named_struct('x', {px}, 'y', {py})) AS pts"
    outer = n.selectExpr("poly_id", "0 AS ring", ring(x, y))
    hole = n.where("poly_id % 4 = 0").selectExpr(
        "poly_id", "1 AS ring", ring(f"({_MID[0]} + {side})", f"({_MID[1]} + {up})"))
    return outer.union(hole)


def area_edges(spark, sf):
    return G.rings_to_edges(G.valid_polygons(area_rings(spark, sf), [BAD_AREA]))


def _sql_edges(pts, ring, where):
    return " UNION ALL ".join(
        f"SELECT poly_id, {ring} AS ring, {s} AS seq, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2 FROM lat_ {where}"
        for s, (a, b) in enumerate(zip(pts, pts[1:]), 1))


AREAS_SQL = (f"lat_ AS (SELECT n_nationkey AS poly_id, {_I} AS i, {_J} AS j FROM nation), edges AS ("
             f"SELECT * FROM ({_sql_edges(_OUTER, 0, '')} UNION ALL {_sql_edges(_HOLE, 1, 'WHERE poly_id % 4 = 0')}) "
             f"WHERE poly_id <> {BAD_AREA})")


def pip_sql(points: str, key: str, edges: str = "edges", x: str = "lon", y: str = "lat") -> str:
    """(key, poly_id) pairs by brute force over all edges."""
    return f"""(SELECT {key}, poly_id FROM {points}, {edges} GROUP BY {key}, poly_id HAVING
      sum(CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < x1 + (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0e0) THEN 1 ELSE 0 END) % 2 = 1
      OR bool_or((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2)
        AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2)))"""


@query("points_from_coords", f"""WITH {POS_SQL} SELECT vec_id, {r('lon')} AS lon, {r('lat')} AS lat FROM pos
WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90""")
def points_from_coords(spark, sf):
    return (positions(spark, sf).where(geo.valid_lonlat("lon", "lat"))
            .select("vec_id", rnd("lon").alias("lon"), rnd("lat").alias("lat")))


@query("point_in_polygon", f"""WITH {POS_SQL}, {AREAS_SQL}
SELECT vec_id, m.poly_id AS area FROM pos LEFT JOIN {pip_sql('pos', 'vec_id')} m USING (vec_id)""")
def point_in_polygon(spark, sf):
    return G.point_in_polygon(positions(spark, sf), area_edges(spark, sf), "lon", "lat").select("vec_id", "area")


# Diamonds around every position, to be overlaid on the areas. Some rings come without their
# closing point.
_D = "(0.1e0 + abs(e2))"
_DIAMOND = [(f"(lon - {_D})", "lat"), ("lon", f"(lat - {_D})"), (f"(lon + {_D})", "lat"), ("lon", f"(lat + {_D})"), (f"(lon - {_D})", "lat")]


def diamond_rings(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in (2, 3)])
    p = positions(spark, sf).join(e, "vec_id")
    pts = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in _DIAMOND) + ")"
    rings = p.selectExpr("vec_id AS poly_id", "0 AS ring", f"{pts} AS pts", "e3 < -0.1e0 AS open")
    return rings.select("poly_id", "ring", F.when(F.col("open"), F.slice("pts", 1, 4)).otherwise(F.col("pts")).alias("pts"))


def diamond_edges(spark, sf):
    return G.rings_to_edges(diamond_rings(spark, sf))


DIAMOND_SQL = (f"{POS_SQL}, dia AS (SELECT vec_id, lon, lat, CAST(embedding[3] AS DOUBLE) AS e2, CAST(embedding[4] AS DOUBLE) AS e3 "
               "FROM pos JOIN embeddings USING (vec_id)), d AS ("
               + " UNION ALL ".join(
                   f"SELECT vec_id AS poly_id, {s} AS seq, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2 FROM dia"
                   for s, (a, b) in enumerate(zip(_DIAMOND, _DIAMOND[1:]), 1)) + ")")


@query("scan_polygons", f"""WITH {DIAMOND_SQL} SELECT poly_id, CAST(seq AS INTEGER) AS seq, {r('x1')} AS x1, {r('y1')} AS y1, {r('x2')} AS x2, {r('y2')} AS y2 FROM d""")
def scan_polygons(spark, sf):
    return diamond_edges(spark, sf).select("poly_id", "seq", *[rnd(c).alias(c) for c in G.EDGE])


@query("exclude_invalid_feature", f"WITH {DIAMOND_SQL} SELECT vec_id AS poly_id FROM dia WHERE vec_id <> {BAD_AREA} AND e3 >= -0.1e0")
def exclude_invalid_feature(spark, sf):
    return G.valid_polygons(diamond_rings(spark, sf), [BAD_AREA]).select("poly_id")


@query("polygon_overlap_join", f"""WITH {AREAS_SQL}, {DIAMOND_SQL},
meet AS (SELECT d.poly_id AS a_id, e.poly_id AS b_id FROM d, edges e WHERE
  least(d.x1, d.x2) <= greatest(e.x1, e.x2) AND least(e.x1, e.x2) <= greatest(d.x1, d.x2)
  AND least(d.y1, d.y2) <= greatest(e.y1, e.y2) AND least(e.y1, e.y2) <= greatest(d.y1, d.y2)
  AND sign((d.x2-d.x1)*(e.y1-d.y1)-(d.y2-d.y1)*(e.x1-d.x1)) * sign((d.x2-d.x1)*(e.y2-d.y1)-(d.y2-d.y1)*(e.x2-d.x1)) <= 0
  AND sign((e.x2-e.x1)*(d.y1-e.y1)-(e.y2-e.y1)*(d.x1-e.x1)) * sign((e.x2-e.x1)*(d.y2-e.y1)-(e.y2-e.y1)*(d.x2-e.x1)) <= 0),
dv AS (SELECT poly_id AS a_id, x1 AS px, y1 AS py FROM d), ev AS (SELECT DISTINCT poly_id AS b_id, x1 AS qx, y1 AS qy FROM edges),
pairs AS (SELECT a_id, b_id FROM meet
  UNION SELECT a_id, poly_id FROM {pip_sql('dv', 'a_id, px, py', 'edges', 'px', 'py').replace('SELECT a_id, px, py, poly_id', 'SELECT a_id, poly_id')}
  UNION SELECT poly_id, b_id FROM {pip_sql('ev', 'b_id, qx, qy', 'd', 'qx', 'qy').replace('SELECT b_id, qx, qy, poly_id', 'SELECT b_id, poly_id')})
SELECT vec_id AS a_id, b_id FROM embeddings LEFT JOIN pairs ON a_id = vec_id""")
def polygon_overlap_join(spark, sf):
    ids = positions(spark, sf).select(F.col("vec_id").alias("a_id"))
    return G.overlap_join(ids, diamond_edges(spark, sf), area_edges(spark, sf))


# ---- projection and grids -------------------------------------------------------------------

def _utm_sql() -> str:
    t = f"sinh(atanh(sin(phi)) - {geo.ECC:.17e} * atanh({geo.ECC:.17e} * sin(phi)))"
    east, north = "eta", "xi"
    for j, a in enumerate(geo.ALPHA, 1):
        east += f" + {a:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        north += f" + {a:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = f"{geo.SCALE * geo.RECTIFYING:.17e}"
    return (f"ang AS (SELECT vec_id, radians(lat) AS phi, radians(lon + 69e0) AS dl FROM pos), "
            f"tt AS (SELECT vec_id, dl, {t} AS t FROM ang), "
            f"xe AS (SELECT vec_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM tt), "
            f"utm AS (SELECT vec_id, 500e0 + {k} * ({east}) AS x, {k} * ({north}) AS y FROM xe)")


UTM_SQL = f"{POS_SQL}, {_utm_sql()}"
GRID_SQL = UTM_SQL + """, ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM utm),
grid AS (SELECT gx, gy, x0 + (gx + 0.5e0) * 10 AS cx, y0 + (gy + 0.5e0) * 10 AS cy FROM ext,
  range(0, 1000) a(gx), range(0, 1000) b(gy)
  WHERE gx < greatest(ceil((x1 - x0) / 10e0), 1) AND gy < greatest(ceil((y1 - y0) / 10e0), 1))"""


def utm_positions(spark, sf):
    return G.add_utm(positions(spark, sf), "lon", "lat", 19)


@query("utm_project", f"WITH {UTM_SQL} SELECT vec_id, {r('x')} AS x, {r('y')} AS y FROM utm")
def utm_project(spark, sf):
    return utm_positions(spark, sf).select("vec_id", rnd("X").alias("x"), rnd("Y").alias("y"))


@query("make_grid_centers", f"WITH {GRID_SQL} SELECT gx, gy, {r('cx')} AS x, {r('cy')} AS y FROM grid")
def make_grid_centers(spark, sf):
    return G.grid_centers(utm_positions(spark, sf)).select("gx", "gy", rnd("X").alias("x"), rnd("Y").alias("y"))


@query("grid_clip_to_survey", f"""WITH {GRID_SQL}
SELECT gx, gy, {r('cx')} AS x, {r('cy')} AS y FROM grid
WHERE EXISTS (SELECT 1 FROM utm WHERE (cx - x) * (cx - x) + (cy - y) * (cy - y) <= 100)""")
def grid_clip_to_survey(spark, sf):
    return G.grid_near_points(utm_positions(spark, sf)).select("gx", "gy", rnd("X").alias("x"), rnd("Y").alias("y"))


@query("bbox_crop", f"""WITH {DIAMOND_SQL}, b AS (SELECT min(lon) + 1 AS xmin, min(lat) + 2 AS ymin, max(lon) - 1 AS xmax,
  max(lat) - 0.5e0 AS ymax FROM pos)
SELECT poly_id, CAST(seq AS INTEGER) AS seq FROM d, b WHERE greatest(x1, x2) >= xmin AND least(x1, x2) <= xmax
  AND greatest(y1, y2) >= ymin AND least(y1, y2) <= ymax""")
def bbox_crop(spark, sf):
    # padded inwards, so that something is cropped
    ext = A.extent_bbox(positions(spark, sf), "lon", "lat", pad=(1.0, 2.0, -1.0, -0.5))
    return G.crop_edges(diamond_edges(spark, sf), ext).select("poly_id", "seq")


@query("cell_mesh_key", f"""WITH {UTM_SQL} SELECT vec_id, CAST(floor(x / 30) AS BIGINT) AS mx, CAST(floor(y / 30) AS BIGINT) AS my FROM utm""")
def cell_mesh_key(spark, sf):
    return G.mesh_cell(utm_positions(spark, sf)).select("vec_id", "mx", "my")


TOWXY_SQL = f"""{TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}, {UTM_SQL}, est AS (
  SELECT tow, est_year, season, trait_size AS est, x, y FROM cwm JOIN utm ON tow = vec_id)"""


def tow_estimates(spark, sf):
    """Tow means at their projected positions."""
    xy = utm_positions(spark, sf).select(F.col("vec_id").alias("tow"), "X", "Y")
    est = tow_cwm(spark, sf).select("tow", "est_year", "season", F.col("trait_size").alias("est"))
    return est.join(xy, "tow")


@query("area_weighted_index", f"WITH {TOWXY_SQL} SELECT est_year, {r('sum(est * 100)', 4)} AS \"index\" FROM est GROUP BY est_year")
def area_weighted_index(spark, sf):
    return G.area_weighted_index(tow_estimates(spark, sf), "est_year", "est", CELL_AREA).withColumn("index", rnd("index", 4))


@query("center_of_gravity", f"""WITH {TOWXY_SQL}
SELECT est_year, {r('sum(x * est) / nullif(sum(est), 0e0)')} AS "X", {r('sum(y * est) / nullif(sum(est), 0e0)')} AS "Y" FROM est GROUP BY est_year""")
def center_of_gravity(spark, sf):
    cog = G.center_of_gravity(tow_estimates(spark, sf), "est_year", "est")
    wide = pivot_values(cog, ["est_year"], "coord", ["est"], ["X", "Y"])
    return wide.select("est_year", rnd("X").alias("X"), rnd("Y").alias("Y"))
