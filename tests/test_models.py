"""Model fits against direct linear algebra on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.operators import ar1, field, linear as L, mixed, pca, quantiles as Q

RNG = np.random.default_rng(7)


def _panel(spark, phi=0.6, n_series=60, years=30):
    rows = []
    for s in range(n_series):
        e, area, season = 0.0, "abc"[s % 3], "xy"[s % 2]
        for t in range(years):
            e = phi * e + RNG.normal() * (np.sqrt(1 - phi**2) if t else 1.0)
            if RNG.random() < 0.8:
                rows.append((s, area, season, t, float(RNG.normal()), float(0.05 * t + (area == "b") * 1.5 + e)))
    return rows, spark.createDataFrame(rows, "s int, area string, season string, t int, temp double, y double")


def _design(rows):
    x = []
    for _, a, se, t, temp, _ in rows:
        ind = [a == "b", a == "c"]
        s = se == "y"
        x.append([1, t, *ind, s, *[t * i for i in ind], t * s, *[i * s for i in ind], *[t * i * s for i in ind], temp])
    return np.array(x, float), np.array([r[-1] for r in rows])


def test_ols_matches_least_squares(spark):
    rows, df = _panel(spark)
    fit = L.fit_ols(df, "y", L.crossed("t", "area", "season") + [("temp",)], ["area", "season"])
    x, y = _design(rows)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    co = {r.term: r for r in fit.coefficients(spark).collect()}
    names = ["(Intercept)", "t", "area[b]", "area[c]", "season[y]", "t:area[b]", "t:area[c]", "t:season[y]",
             "area[b]:season[y]", "area[c]:season[y]", "t:area[b]:season[y]", "t:area[c]:season[y]", "temp"]
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    for n, b, e in zip(names, beta, se):
        assert co[n].estimate == pytest.approx(b, abs=1e-9) and co[n].std_error == pytest.approx(e, rel=1e-8)
    got = {(r.s, r.t): (r.estimate, r.std_error) for r in fit.predict_interval(df).collect()}
    v = np.linalg.inv(x.T @ x) * s2
    for i in (0, 17, 400):
        est, err = got[(rows[i][0], rows[i][3])]
        assert est == pytest.approx(x[i] @ beta, abs=1e-9) and err == pytest.approx(np.sqrt(x[i] @ v @ x[i]), rel=1e-7)


def test_gls_matches_dense_covariance(spark):
    rows, df = _panel(spark, n_series=12, years=15)
    fit = ar1.fit_gls_ar1(df, "y", L.crossed("t", "area", "season") + [("temp",)], ["area", "season"], ["s"], "t")
    x, y = _design(rows)
    phi = fit.extra["phi"]
    s, t = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    v = np.where(s[:, None] == s[None, :], float(phi) ** np.abs(t[:, None] - t[None, :]), 0.0)
    vi = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
    co = {r.term: r.estimate for r in fit.coefficients(spark).collect()}
    assert co["t"] == pytest.approx(beta[1], abs=1e-8) and co["temp"] == pytest.approx(beta[-1], abs=1e-8)
    assert co["(Intercept)"] == pytest.approx(beta[0], abs=1e-8)

    def reml(p):
        w = np.where(s[:, None] == s[None, :], float(p) ** np.abs(t[:, None] - t[None, :]), 0.0)
        wi = np.linalg.inv(w)
        b = np.linalg.solve(x.T @ wi @ x, x.T @ wi @ y)
        rss = (y - x @ b) @ wi @ (y - x @ b)
        k = len(y) - x.shape[1]
        return -k / 2 * np.log(rss / k) - np.linalg.slogdet(w)[1] / 2 - np.linalg.slogdet(x.T @ wi @ x)[1] / 2
    grid = np.linspace(max(phi - 0.3, 0.01), min(phi + 0.3, 0.99), 61)
    assert reml(phi) >= max(reml(g) for g in grid) - 1e-6


def test_gls_recovers_correlation(spark):
    _, df = _panel(spark)
    fit = ar1.fit_gls_ar1(df, "y", L.crossed("t", "area"), ["area"], ["s"], "t")
    assert fit.extra["phi"] == pytest.approx(0.6, abs=0.1)


def test_gls_needs_unique_times(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 1.5)], "s int, t int, y double")
    with pytest.raises(Exception, match="duplicate key"):
        ar1.fit_gls_ar1(df, "y", [("t",)], [], ["s"], "t")


def test_mixed_crossed_effects(spark):
    u, w = RNG.normal(size=40) * 2.0, RNG.normal(size=8) * 0.8
    rows = [(int(g), int(h), float(x), float(1 + 0.5 * x + u[g] + w[h] + RNG.normal() * 1.5))
            for g, h, x in zip(RNG.integers(0, 40, 1500), RNG.integers(0, 8, 1500), RNG.normal(size=1500))]
    df = spark.createDataFrame(rows, "g int, h int, x double, y double")
    fit = mixed.fit_mixed(df, "y", [("x",)], (mixed.RandomTerm("g"), mixed.RandomTerm("h")))
    assert fit.fixed["x"][0] == pytest.approx(0.5, abs=0.1)
    assert fit.residual == pytest.approx(2.25, abs=0.3)
    assert fit.covariances["g"][0, 0] == pytest.approx(np.var(u, ddof=1), rel=0.15)
    blup = np.array([fit.effects["g"][str(i)][0] for i in range(40)])
    assert np.corrcoef(blup, u)[0, 1] > 0.97
    # the estimates solve the mixed-model equations of the full data
    z = np.zeros((1500, 48))
    for i, r in enumerate(rows):
        z[i, r[0]] = z[i, 40 + r[1]] = 1
    x = np.array([[1, r[2]] for r in rows])
    y = np.array([r[3] for r in rows])
    d = np.r_[np.full(40, fit.covariances["g"][0, 0]), np.full(8, fit.covariances["h"][0, 0])]
    v = z @ np.diag(d) @ z.T + np.eye(1500) * fit.residual
    b = np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, y))
    assert fit.fixed["x"][0] == pytest.approx(b[1], abs=1e-4)


def test_mixed_correlated_slopes(spark):
    g = np.array([[4.92, 1.02], [1.02, 0.72]])
    u = RNG.multivariate_normal([0, 0], g, size=80)
    rows = []
    for i in range(80):
        for _ in range(30):
            x = RNG.normal()
            rows.append((i, float(x), float(2 + x + u[i, 0] + u[i, 1] * x + RNG.normal())))
    fit = mixed.fit_mixed(spark.createDataFrame(rows, "g int, x double, y double"), "y", [("x",)],
                          (mixed.RandomTerm("g", ("x",)),))
    assert np.allclose(fit.covariances["g"], np.cov(u.T), rtol=0.15, atol=0.1)
    assert fit.residual == pytest.approx(1.0, abs=0.1)


def test_pca_invariants(spark):
    z = RNG.normal(size=(400, 5)) @ RNG.normal(size=(5, 5)) + 10
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "id int, a double, b double, c double, d double, e double")
    fit = pca.fit_pca(df, list("abcde"), 3)
    s = np.array([tuple(r) for r in fit.scores(df, ["id"]).collect()])[:, 1:]
    assert np.allclose(s.mean(0), 0, atol=1e-9)
    var = s.var(0, ddof=1)
    assert np.all(np.diff(var) <= 1e-9) and np.allclose(var, fit.variance[:3])
    assert np.allclose(np.corrcoef(s.T) - np.eye(3), 0, atol=1e-9)
    assert fit.proportion.sum() == pytest.approx(1.0)
    top = np.abs(fit.loadings).argmax(0)
    assert all(fit.loadings[t, j] > 0 for j, t in enumerate(top))


def test_field_shrinks_towards_the_mean(spark):
    rows = [(c, t, float(10 + 3 * c + RNG.normal())) for c in range(6) for t in range(5) for _ in range(4)]
    df = spark.createDataFrame(rows, "c int, t int, v double")
    f = field.cell_field(df, ["c"], "t", "v")
    got = {r.c: r.mu + r.cell_effect for r in f.collect()}
    for c in range(6):
        raw = np.mean([r[2] for r in rows if r[0] == c])
        grand = np.mean([r[2] for r in rows])
        assert abs(got[c] - grand) <= abs(raw - grand) + 1e-9 and got[c] == pytest.approx(raw, abs=0.5)
    grid = spark.createDataFrame([(0, 0), (99, 0), (0, 99)], "c int, t int")
    out = {(r.c, r.t): r.est for r in field.predict_field(grid, f, ["c"], "t").collect()}
    assert out[(99, 0)] == pytest.approx(np.mean([r[2] for r in rows]))


@pytest.mark.parametrize("kind", ["spread", "outlier", "copies", "hot"])
def test_exact_quantiles(spark, kind):
    n = 20_000
    v = RNG.normal(size=n)
    g = RNG.integers(0, 4, n)
    if kind == "outlier":
        v[0] = 1e12
    if kind == "copies":
        v[: n // 3] = 0.25
    if kind == "hot":
        g[: n // 2] = 1
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    for r in Q.exact_quantiles(df, ["g"], "v", probs).collect():
        assert r.q == pytest.approx(list(np.quantile(v[g == r.g], probs)), rel=1e-12, abs=1e-12) and r.n == (g == r.g).sum()
    whole = Q.exact_quantiles(df, [], "v", probs, accuracy=50, bins=8).first()
    assert whole.q == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=1e-12)


def test_many_cells(spark):
    """More factor combinations than any driver table should hold, with the fit of dense algebra."""
    n = 300_000
    df = spark.range(n).select((F.col("id") % 600).cast("string").alias("f"), F.floor(F.col("id") / 600).cast("string").alias("g"),
                               (F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") * 13 % 97).cast("double").alias("y"))
    cells = L.cell_moments(df, ["f", "g"], ["x", "y"])
    _, centers, rows = L.facts_of(cells, ["f"], ["x", "y"])
    assert rows == n
    cols = L.design([("x",)], {})
    sums = L.design_sums(cells, cols, {None: 0, "x": 1}, 3, 2, {"v": lambda i, j: L.moment(["x", "y"], centers, i, j)}).collect()
    xx, xy, yy = L.square(sums, "v", 2)
    i = np.arange(n)
    x, y = i * 7 % 101 - centers["x"], i * 13 % 97 - centers["y"]
    assert xx == pytest.approx(np.array([[n, 0], [0, x @ x]]), rel=1e-9, abs=1e-3)
    assert (xy[1], yy) == pytest.approx((x @ y, y @ y), rel=1e-9, abs=1e-3)


def test_combination_that_never_occurs(spark):
    rng = np.random.default_rng(3)
    rows = [(a, b, float(v)) for a, b, v in zip(rng.choice(["p", "q"], 60), rng.choice(["r", "s"], 60), rng.standard_normal(60))
            if (a, b) != ("q", "s")]
    fit = L.fit_ols(spark.createDataFrame(rows, "a string, b string, y double"), "y", [("a",), ("b",), ("a", "b")], ["a", "b"])
    got = {r.term: r.estimate for r in fit.coefficients(spark).collect()}
    mean = lambda a, b: np.mean([v for x, z, v in rows if (x, z) == (a, b)])
    values = list(got.values())
    assert values[:3] == pytest.approx([mean("p", "r"), mean("q", "r") - mean("p", "r"), mean("p", "s") - mean("p", "r")])
    assert values[3] is None and len(values) == 4


def test_correlation_near_one_is_not_clipped(spark):
    from shoalmark.operators.ar1 import fit_gls_ar1
    walk = np.cumsum(np.random.default_rng(5).standard_normal(400))
    rows = [("s", i, float(i % 7), float(v)) for i, v in enumerate(walk)]
    df = spark.createDataFrame(rows, "s string, t int, x double, y double")
    assert fit_gls_ar1(df, "y", [("x",)], [], ["s"], "t").extra["phi"] > 0.99
    turns = [("s", i, float(i % 7), float((-1) ** i * (10 + v / 50))) for i, v in enumerate(walk)]
    df = spark.createDataFrame(turns, "s string, t int, x double, y double")
    assert fit_gls_ar1(df, "y", [("x",)], [], ["s"], "t").extra["phi"] < -0.95


@pytest.mark.parametrize("slopes", [(), ("x",)])
def test_a_term_on_the_cluster_gives_the_same_fit(spark, monkeypatch, slopes):
    rng = np.random.default_rng(3)
    u, s, w = rng.normal(size=30) * 2, rng.normal(size=30) * 0.7, rng.normal(size=5)
    rows = [(f"v={g}", int(h), float(x), float(1 + 0.5 * x + u[g] + s[g] * x + w[h] + rng.normal()))
            for g, h, x in zip(rng.integers(0, 30, 900), rng.integers(0, 5, 900), rng.normal(size=900))]
    df = spark.createDataFrame(rows, "g string, h int, x double, y double")
    terms = mixed.RandomTerm("h"), mixed.RandomTerm("g", slopes)
    want = mixed.fit_mixed(df, "y", [("x",)], terms)
    monkeypatch.setattr(mixed, "MAX_LEVELS", 10)
    got = mixed.fit_mixed(df, "y", [("x",)], terms)
    assert want.absorbed is None and got.absorbed is not None and got.iterations == want.iterations
    assert got.residual == pytest.approx(want.residual, rel=1e-6)
    for g in ("g", "h"):
        assert np.allclose(got.covariances[g], want.covariances[g], rtol=1e-5)
    key = lambda fit: {(r.kind, r.term, r.part): (r.estimate, r.std_error) for r in fit.table(spark).collect()}
    a, b = key(want), key(got)
    assert a.keys() == b.keys()
    assert all(np.allclose([x or 0 for x in a[k]], [x or 0 for x in b[k]], atol=1e-5) for k in a)


def test_many_random_levels(spark):
    """A balanced one-way layout of 5,000 levels, whose REML estimates are those of the analysis of variance."""
    rng = np.random.default_rng(4)
    y = 3 + 2 * rng.normal(size=(5000, 1)) + rng.normal(size=(5000, 4))
    df = spark.createDataFrame([(i, float(v)) for i, r in enumerate(y) for v in r], "g int, y double")
    fit = mixed.fit_mixed(df, "y", [], (mixed.RandomTerm("g"),))
    within = y.var(axis=1, ddof=1).mean()
    between = y.mean(axis=1).var(ddof=1) - within / 4
    assert fit.residual == pytest.approx(within, rel=1e-5)
    assert fit.covariances["g"][0, 0] == pytest.approx(between, rel=1e-5)
    assert fit.fixed["(Intercept)"][0] == pytest.approx(y.mean(), rel=1e-8)
    assert fit.table(spark).where("kind = 'effect'").count() == 5000


def test_two_large_random_terms_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixed, "MAX_LEVELS", 5)
    df = spark.range(40).select(F.col("id").alias("g"), (F.col("id") % 20).alias("h"), (F.col("id") * 1.0).alias("y"))
    with pytest.raises(ValueError, match="beside the largest"):
        mixed.fit_mixed(df, "y", [], (mixed.RandomTerm("g"), mixed.RandomTerm("h")))
