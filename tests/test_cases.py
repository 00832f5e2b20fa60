"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from shoalmark.functions import columns as K, geo, nulls as N
from shoalmark.operators import aggregates as A, community as C, joins as J, ordering as O, quantiles as Q, reshape as R
from shoalmark.operators import series as S, spatial as G, taxonomy as X, trait_sources as T

TRAITS = [(1, 0.5), (2, 0.9), (3, 0.2)]
CATCH = [("s1", 1, 2.0), ("s1", 2, 1.0), ("s1", 3, 1.0), ("s2", 2, 4.0), ("s3", 1, 0.0)]


def _cwm(spark, traits, **kw):
    t = spark.createDataFrame(traits, "sp int, t double")
    c = spark.createDataFrame(CATCH, "site string, sp int, b double")
    return {x.site: x.t for x in C.cwm(c, t, ["site"], "sp", "b", ["t"], **kw).collect()}


def test_cwm(spark):
    got = _cwm(spark, TRAITS)
    assert got["s1"] == pytest.approx(0.525) and got["s2"] == pytest.approx(0.9) and got["s3"] is None


def test_cwm_missing_trait(spark):
    holed = [(1, 0.5), (2, 0.9), (3, None)]
    assert set(_cwm(spark, holed, na_policy="propagate").values()) == {None}
    got = _cwm(spark, holed)
    assert got["s1"] == pytest.approx(1.9 / 3) and got["s2"] == pytest.approx(0.9) and got["s3"] is None


def test_cwm_propagate_without_holes(spark):
    got = _cwm(spark, TRAITS, na_policy="propagate")
    assert got["s1"] == pytest.approx(0.525) and got["s2"] == pytest.approx(0.9)


def test_cwm_two_ways(spark):
    t = spark.createDataFrame(TRAITS, "sp int, t double")
    c = spark.createDataFrame(CATCH, "site string, sp int, b double")
    got = {x.site: x.t for x in C.cwm_by_proportion(c, t, ["site"], "sp", "b", ["t"]).collect()}
    assert got["s1"] == pytest.approx(0.525) and got["s3"] is None


def test_midpoint(spark, rows):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 1.0), (3, 1.0, 2.0), (4, None, None)], "i int, x double, y double")
    assert rows(df.select("i", K.midpoint("x", "y"))) == [(1, 1.0), (2, 1.0), (3, 1.5), (4, None)]


def test_egg_diameter(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 3.0, 9.0), (2, None, None, 9.0), (3, None, 3.0, 9.0)], "i int, a double, b double, m double")
    assert rows(df.select("i", K.egg_diameter("a", "b", "m"))) == [(1, 2.0), (2, 9.0), (3, 3.0)]


def test_seasons(spark):
    days = [91, 92, 182, 183, 274, 275]
    df = spark.createDataFrame([(d,) for d in days], "d int").where(K.survey_days("d"))
    assert {x.d: x.s for x in df.select("d", K.season_from_day("d").alias("s")).collect()} == {
        92: "spring", 182: "spring", 275: "fall"}


def test_decades(spark):
    df = spark.createDataFrame([(y,) for y in (1965, 1979, 1980, 1999, 2000, 2010, 2024, None)], "y int")
    assert [x[0] for x in df.select(K.decade("y")).collect()] == [
        "1970-1979", "1970-1979", "1980-1989", "1990-1999", "2000-2009", "2010-2019", "2010-2019", None]


def test_text(spark):
    df = spark.createDataFrame([(7, "UROPHYCIS earlli"), (123, "x"), (1234, None)], "n int, s string")
    got = df.select(K.zero_pad("n"), K.sentence_case("s"), K.word("s", 1), N.paste("n", "s", sep="-")).collect()
    assert [tuple(g) for g in got] == [("007", "Urophycis earlli", "earlli", "7-UROPHYCIS earlli"), ("123", "X", None, "123-x"), ("1234", None, None, "1234-NA")]


def test_not_in_keeps_missing(spark, rows):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "x string")
    assert rows(df.where(N.not_in("x", ["a"]))) == [("b",), (None,)]


def test_sums(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", None), ("q", None), ("q", None)], "g string, x double")
    got = {r.g: (r.s, r.z) for r in df.groupBy("g").agg(N.strict_sum("x").alias("s"), N.sum0("x").alias("z")).collect()}
    assert got == {"p": (None, 1.0), "q": (None, 0.0)}


def test_ratio_and_log(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "a double, b double")
    assert [tuple(x) for x in df.select(N.ratio("a", "b"), N.ln0("a")).collect()] == [(None, 0.0), (0.0, None)]


def test_mean_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert df.agg(N.mean_na("x")).first()[0] == 2.0


def test_autocorrelation(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (1, 2, 3, 4)], "g string, t int, x double")
    got = {r.lag: r.acf for r in S.autocorrelation(df, ["g"], ["t"], "x").collect()}
    assert got == {0: 1.0, 1: pytest.approx(0.25), 2: pytest.approx(-0.3), 3: pytest.approx(-0.45)}


def test_ar1_recursion(spark):
    df = spark.createDataFrame([("r", 1, 9.0, 1.0), ("r", 3, 3.0, 1.0), ("r", 2, 2.0, 1.0)], "g string, y int, m double, x0 double")
    got = {r.y: r.x_hat for r in S.ar1_recursion(df, "g", "y", "m", "x0", 0.5).collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 4.25}


def test_ar1_recursion_needs_unique_years(spark):
    df = spark.createDataFrame([("r", 1, 9.0, 1.0), ("r", 1, 3.0, 1.0)], "g string, y int, m double, x0 double")
    with pytest.raises(Exception, match="duplicate key"):
        S.ar1_recursion(df, "g", "y", "m", "x0", 0.5).collect()


def test_quantiles_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "v double")
    q = Q.exact_quantiles(df, [], "v", [0.025, 0.5, 0.975]).first()
    assert q.n == 4 and q.q == pytest.approx([1.075, 2.5, 9.475])


SQUARES = [("A", 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]),
           ("B", 0, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)])]
RINGS = "poly_id string, ring int, pts array<struct<x:double,y:double>>"


@pytest.mark.parametrize("cell", [0.3, 7.0])
def test_point_in_polygon(spark, rows, cell):
    edges = G.rings_to_edges(spark.createDataFrame(SQUARES, RINGS))
    pts = [(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 3.0, 3.0), (4, 1.0, 1.0), (5, 1.5, 0.0), (6, 0.5, 1.0)]
    p = spark.createDataFrame(pts, "i int, x double, y double")
    got = rows(G.point_in_polygon(p, edges, "x", "y", cell).select("i", "area"))
    assert got == [(1, "A"), (2, "A"), (2, "B"), (3, None), (4, "A"), (4, "B"), (5, "B"), (6, "A")]


def test_point_in_hole(spark, rows):
    rings = SQUARES[:1] + [("A", 1, [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)])]
    edges = G.rings_to_edges(spark.createDataFrame(rings, RINGS))
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.4, 0.5), (3, 0.2, 0.5)], "i int, x double, y double")
    assert rows(G.point_in_polygon(p, edges, "x", "y", 0.25).select("i", "area")) == [(1, None), (2, "A"), (3, "A")]


def test_polygon_overlap(spark, rows):
    def sq(name, x, y, s):
        return (name, 0, [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])
    hole = ("big", 1, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)])
    b = G.rings_to_edges(spark.createDataFrame([sq("big", 0.0, 0.0, 10.0), hole], RINGS))
    a = G.rings_to_edges(spark.createDataFrame(
        [sq("nested", 1.0, 1.0, 1.0), sq("inhole", 4.5, 4.5, 1.0), sq("touch", 10.0, 3.0, 2.0),
         sq("cross", 9.0, 9.0, 5.0), sq("far", 30.0, 30.0, 1.0), sq("around", -5.0, -5.0, 40.0)], RINGS))
    got = rows(G.polygon_overlap(a, b, 2.0))
    assert got == [("around", "big"), ("cross", "big"), ("nested", "big"), ("touch", "big")]


def test_utm(spark):
    df = spark.createDataFrame([(-79.387139, 43.642567)], "lon double, lat double")
    r = G.add_utm(df, "lon", "lat", 17).first()
    assert r.X == pytest.approx(630.0843, abs=1e-3) and r.Y == pytest.approx(4833.4386, abs=1e-3)


def test_center_of_gravity(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 3.0)], "yr int, X double, Y double, est double")
    assert {r.coord: r.est for r in G.center_of_gravity(df, "yr", "est").collect()} == {"X": 7.5, "Y": 0.0}


def test_grid_near_points_matches_brute_force(spark):
    pts = [(0.0, 0.0), (3.0, 4.0), (57.0, 12.0), (95.0, 44.0), (95.0, 44.0)]
    df = spark.createDataFrame(pts, "X double, Y double")
    grid = [tuple(r) for r in G.grid_centers(df).collect()]
    want = {(g[0], g[1]) for g in grid if any(math.hypot(g[2] - x, g[3] - y) <= 10 for x, y in pts)}
    assert {(r.gx, r.gy) for r in G.grid_near_points(df).collect()} == want and len(grid) == 50


def test_complete_grid(spark, rows):
    df = spark.createDataFrame([(1, "a", "s", 1.0), (2, "a", "f", 2.0)], "y int, a string, s string, m double")
    assert rows(R.complete_grid(df, ["y", "a", "s"])) == [(1, "a", "f", None), (1, "a", "s", 1.0), (2, "a", "f", 2.0), (2, "a", "s", None)]


def test_complete_grid_keeps_missing_level(spark, rows):
    df = spark.createDataFrame([(1, None, 1.0), (2, "b", 2.0)], "y int, a string, m double")
    assert rows(R.complete_grid(df, ["y", "a"])) == [(1, "b", None), (1, None, 1.0), (2, "b", 2.0), (2, None, None)]


def test_replicate(spark, rows):
    df = spark.createDataFrame([(i, "x") for i in range(20)], "i int, s string")
    years = spark.createDataFrame([(y,) for y in range(7)], "y int")
    few = rows(R.replicate(df, years))
    assert few == sorted(((i, "x", y) for i in range(20) for y in range(7)), key=repr) == rows(R.replicate(df, years, salts=3))
    many = R.replicate(spark.range(3), spark.range(20_000).toDF("y"))
    assert many.count() == 60_000 == many.distinct().count()


def test_pivot_refuses_an_undeclared_level(spark):
    df = spark.createDataFrame([("s1", "A", 1.0), ("s1", "C", 2.0)], "s string, k string, v double")
    with pytest.raises(Exception, match="not among the declared levels: C"):
        R.pivot_fill0(df, ["s"], "k", "v", ["A", "B"]).collect()


def test_histogram_of_a_constant(spark, rows):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "v double")
    assert rows(A.histogram(df, "v", 20)) == [(1, 2)]


def test_many_polygons_in_one_cell(spark):
    squares = [(i, 0, [(0.0, 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (0.0, 1.0)]) for i in range(2000)]
    edges = G.rings_to_edges(spark.createDataFrame(squares, RINGS.replace("poly_id string", "poly_id int")))
    p = spark.createDataFrame([(1, 1500.5, 0.5), (2, 0.5, 5.0)], "i int, x double, y double")
    got = G.point_in_polygon(p, edges, "x", "y", 4000.0).collect()
    assert sorted(r.area for r in got if r.i == 1) == list(range(1500, 2000)) and [r.area for r in got if r.i == 2] == [None]


def test_pivot_fill0(spark):
    df = spark.createDataFrame([("s1", 10, 1.0), ("s2", 10, None), ("s2", 11, 2.0)], "s string, k int, v double")
    got = {r.s: (r["10"], r["11"]) for r in R.pivot_fill0(df, ["s"], "k", "v", [11, 10]).collect()}
    assert got == {"s1": (1.0, 0.0), "s2": (None, 2.0)}


def test_rank_fallback(spark):
    tax = spark.createDataFrame([("Aus bus", "Aus", None, "Aidae", "Aiformes", "C", "S")],
                                "species string, genus string, subfamily string, family string, order string, class string, super_class string")
    names = spark.createDataFrame([("Aus",), ("Aidae",), ("Aiformes",), ("Zus",)], "name string")
    got = {r.name: (r.genus, r.family, r.order, r.super_class) for r in X.rank_fallback_join(names, "name", tax).collect()}
    assert got == {"Aus": ("Aus", "Aidae", "Aiformes", "S"), "Aidae": (None, "Aidae", "Aiformes", "S"), "Aiformes": (None, None, "Aiformes", "S")}


def test_trait_gap_fill(spark):
    rule = (T.TraitRule(("fecundity",), "level_fecundity", "reference_fecundity"),)
    a = spark.createDataFrame([("x", 5.0, "spe", "A"), ("y", 6.0, "spe", "A"), ("y", 8.0, "gen", "A"), ("z", 9.0, None, "A"), ("off", 1.0, "spe", "A")],
                              "species string, fecundity double, level_fecundity string, reference_fecundity string")
    b = spark.createDataFrame([("x", 50.0, 1.0), ("y", 60.0, 2.0), ("w", 70.0, 3.0), ("off2", 1.0, 1.0)], "species string, fecundity double, temperature double")
    sp = spark.createDataFrame([(s,) for s in "xyzwv"], "species string")
    got = sorted((r.species, r.fecundity, r.reference_fecundity, r.temperature, r.reference_temperature) for r in
                 T.trait_gap_fill(sp, a, b, rules=rule, second_only={"temperature": "reference_temperature"}).collect())
    assert got == [("w", 70.0, "B", 3.0, "B"), ("x", 5.0, "A", 1.0, "B"), ("y", 60.0, "B", 2.0, "B"), ("y", 60.0, "B", 2.0, "B"),
                   ("z", 9.0, "A", None, None)]


def test_membership(spark):
    def keys(s):
        return spark.createDataFrame([(c,) for c in s], "k string")
    got = {r.k: r.membership for r in J.classify_membership(keys("abcd"), keys("abbx"), keys("bc"), "k").collect()}
    assert got == {"a": "only_a", "b": "both", "c": "only_b"}


def test_natural_join_rejects_unexpected_keys(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, tmax double")
    with pytest.raises(ValueError):
        J.natural_join(a, a, ["k"])


def test_null_safe_join(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, k string")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, v int")
    assert rows(J.natural_join(a, b, ["k"], null_safe=True)) == [(1, "x", 10), (2, None, 20)]


def test_enrich_back_rejects_conflicts(spark):
    r = spark.createDataFrame([(1,)], "k int")
    m = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="attributes differ"):
        J.enrich_back(r, m, ["k"], ["v"]).collect()


def test_row_id_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v")).repartition(13)
    got = O.with_row_id(df, ["v"], "pos").collect()
    assert all(r.pos == r.v + 1 for r in got) and len(got) == 5000


def test_missing_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "i int, v double")
    up = [r.i for r in df.orderBy(*O.nulls_last("v")).collect()]
    down = [r.i for r in df.orderBy(*O.nulls_last("v", desc=["v"])).collect()]
    assert up == [2, 3, 1] and down == [3, 2, 1]


def test_valid_lonlat(spark):
    df = spark.createDataFrame([(0.0, 0.0), (181.0, 0.0), (0.0, -91.0)], "lon double, lat double")
    assert df.where(geo.valid_lonlat("lon", "lat")).count() == 1
