"""Fits whose variances lie far above the residual one, or at 0."""

import numpy as np
import pytest

from shoalmark.operators import field, mixed

CELLS, YEARS = 10, 7


def _panel(spark):
    """Complete cells x years x seasons with a small residual, and its analysis of variance."""
    rng = np.random.default_rng(5)
    y = (12 + 4 * rng.normal(size=(CELLS, 1, 1)) + 1.4 * rng.normal(size=(CELLS, YEARS, 1)) + np.array([0.0, 0.3])
         + 0.04 * rng.normal(size=(CELLS, YEARS, 2)))
    rows = [(c, t, "FS"[s], float(y[c, t, s])) for c in range(CELLS) for t in range(YEARS) for s in range(2)]
    m, cell, time, season = y.mean(), y.mean(axis=(1, 2)), y.mean(axis=2), y.mean(axis=(0, 1))
    msc = 2 * YEARS * ((cell - m) ** 2).sum() / (CELLS - 1)
    mst = 2 * ((time - cell[:, None]) ** 2).sum() / (CELLS * (YEARS - 1))
    mse = ((y - time[:, :, None] - season + m) ** 2).sum() / (CELLS * YEARS - 1)
    u = (msc - mst) / msc * (cell - m)
    w = (mst - mse) / mst * (time - m - u[:, None])
    variances = {"cell": (msc - mst) / (2 * YEARS), "cell by time": (mst - mse) / 2, "residual": mse}
    return spark.createDataFrame(rows, "cell int, yr int, season string, y double"), variances, u, w, season


def _fit(df):
    return field.fit_covariate_field(df, ["cell"], "yr", "y", [("season",)], {"season": ["F", "S"]})


def test_field_far_above_its_residual(spark):
    df, variances, u, w, _ = _panel(spark)
    fit = _fit(df)
    got = {r.term: r.estimate for r in fit.estimates(spark).where("kind = 'variance'").collect()}
    assert got == {k: pytest.approx(v, rel=1e-6) for k, v in variances.items()}
    for r in fit.effects().collect():
        assert r.cell_effect == pytest.approx(u[r.cell], abs=1e-6) and r.time_effect == pytest.approx(w[r.cell, r.yr], abs=1e-6)


def test_predictions_far_above_the_residual(spark):
    df, _, u, w, season = _panel(spark)
    grid = spark.createDataFrame([(c, t, s, 0.0) for c in (3, 99) for t in (2, 50) for s in "FS"], df.schema)
    for r in _fit(df).predict(grid).collect():
        want = season["FS".index(r.season)] + (u[3] if r.cell == 3 else 0) + (w[3, 2] if (r.cell, r.yr) == (3, 2) else 0)
        assert r.est == pytest.approx(want, abs=1e-6)


def _deviance(rows, terms, covariances, residual):
    """Restricted deviance of the given variances, by the covariance of the response. Rows end with the response."""
    y = np.array([r[-1] for r in rows])
    x = np.array([[1.0, r[-2]] for r in rows])
    v = np.eye(len(rows)) * residual
    for at, slope, g in [(at, slope, covariances[name]) for name, at, slope in terms]:
        z = np.array([[1.0, r[-2]] if slope else [1.0] for r in rows])
        same = np.equal.outer([r[at] for r in rows], [r[at] for r in rows])
        v += same * (z @ g @ z.T)
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    e = y - x @ np.linalg.solve(xvx, x.T @ vi @ y)
    return (len(y) - 2) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + e @ vi @ e


def _weak(spark, seed, slope):
    """Two crossed terms with hardly any variance."""
    rng = np.random.default_rng(seed)
    n = 1200
    rows = [(int(g), int(h), float(x), float(2 + 0.3 * x + 3 * e)) for g, h, x, e in
            zip(rng.integers(0, 8, n), rng.integers(0, 5, n), rng.normal(size=n), rng.normal(size=n))]
    df = spark.createDataFrame(rows, "g int, h int, x double, y double")
    return rows, mixed.fit_mixed(df, "y", [("x",)], (mixed.RandomTerm("g"), mixed.RandomTerm("h", ("x",) if slope else ())))


def _is_least(rows, fit, slope):
    terms = [("g", 0, False), ("h", 1, slope)]
    least = _deviance(rows, terms, fit.covariances, fit.residual)
    assert fit.deviance_reml == pytest.approx(least, abs=1e-6)
    for name, g in fit.covariances.items():
        steps = [s * np.outer(v, v) for v in np.vstack([np.eye(len(g)), np.ones((1, len(g))), np.eye(len(g))[:1] - np.eye(len(g))[-1:]])
                 for s in (1e-5, 1e-3, 0.03) if v.any()]
        for other in [*[g + s for s in steps], 0.9 * g, 0.5 * g, 0 * g]:
            assert _deviance(rows, terms, {**fit.covariances, name: other}, fit.residual) > least - 1e-7


@pytest.mark.parametrize("seed", range(3))
def test_variances_near_zero(spark, seed):
    rows, fit = _weak(spark, seed, False)
    _is_least(rows, fit, False)
    assert fit.iterations < 100


@pytest.mark.parametrize("seed", range(3))
def test_slopes_near_zero(spark, seed):
    rows, fit = _weak(spark, seed, True)
    _is_least(rows, fit, True)
    assert fit.iterations < 200
