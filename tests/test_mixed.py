"""Mixed models against dense linear algebra: every way of solving, predictions, intervals, likelihood."""

import numpy as np
import pytest

from shoalmark.operators import comparison, linear as L, mixed

RNG = np.random.default_rng(21)


def _crossed_rows(n, g, h, slope=0.0):
    u, w, b = RNG.normal(size=g) * 1.5, RNG.normal(size=h) * 0.8, RNG.normal(size=g) * slope
    return [(int(i), int(j), float(x), "ab"[int(k)], float(1 + 0.5 * x + 0.7 * k + u[i] + b[i] * x + w[j] + RNG.normal()))
            for i, j, x, k in zip(RNG.integers(0, g, n), RNG.integers(0, h, n), RNG.normal(size=n), RNG.integers(0, 2, n))]


SCHEMA = "g int, h int, x double, f string, y double"


class Dense:
    """The model at given variances, by the covariance of the response."""

    def __init__(self, rows, covariances, residual, slopes=False):
        n = len(rows)
        self.x = np.array([[1, r[2], r[3] == "b"] for r in rows], float)
        self.y = np.array([r[4] for r in rows])
        self.gs, self.hs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        d = 2 if slopes else 1
        z = np.zeros((n, d * len(self.gs) + len(self.hs)))
        for k, r in enumerate(rows):
            at = d * self.gs.index(r[0])
            z[k, at] = 1
            if slopes:
                z[k, at + 1] = r[2]
            z[k, d * len(self.gs) + self.hs.index(r[1])] = 1
        big = np.zeros((z.shape[1],) * 2)
        for i in range(len(self.gs)):
            big[d * i:d * i + d, d * i:d * i + d] = covariances["g"]
        at = d * len(self.gs)
        big[at:, at:] = np.eye(len(self.hs)) * covariances["h"][0, 0]
        self.z, self.big, self.d = z, big, d
        self.v = z @ big @ z.T + np.eye(n) * residual
        self.vi = np.linalg.inv(self.v)
        self.cov = np.linalg.inv(self.x.T @ self.vi @ self.x)
        self.beta = self.cov @ self.x.T @ self.vi @ self.y
        e = self.y - self.x @ self.beta
        self.u = big @ z.T @ self.vi @ e
        quad, const = e @ self.vi @ e, np.log(2 * np.pi)
        self.ml = n * const + np.linalg.slogdet(self.v)[1] + quad
        self.reml = (n - 3) * const + np.linalg.slogdet(self.v)[1] + np.linalg.slogdet(self.x.T @ self.vi @ self.x)[1] + quad

    def error(self, x, z):
        """Variance of the prediction error of x'beta + z'u."""
        c = z @ self.big @ self.z.T @ self.vi
        rest = x - c @ self.x
        return z @ self.big @ z - c @ self.z @ self.big @ z + rest @ self.cov @ rest


def _dense_of(rows, fit, slopes=False):
    return Dense(rows, fit.covariances, fit.residual, slopes)


@pytest.mark.parametrize("limit,slopes", [(2000, False), (2000, True), (30, False), (30, True)])
def test_mixed_equals_dense(spark, limit, slopes):
    rows = _crossed_rows(900, 40, 12, 0.6 if slopes else 0.0)
    df = spark.createDataFrame(rows, SCHEMA)
    random = (mixed.RandomTerm("g", ("x",) if slopes else ()), mixed.RandomTerm("h"))
    fit = mixed.fit_mixed(df, "y", [("x",), ("f",)], random, {"f": ["a", "b"]}, max_levels=limit)
    want = _dense_of(rows, fit, slopes)
    assert fit.iterations < 40
    assert np.allclose(fit.beta, want.beta, atol=1e-7) and np.allclose(fit.cov, want.cov, rtol=1e-6)
    assert fit.deviance == pytest.approx(want.ml, abs=1e-6 * abs(want.ml)) and fit.deviance_reml == pytest.approx(want.reml, abs=1e-6 * abs(want.reml))
    got = fit.effects
    own = np.concatenate([got["g"][str(k)] for k in want.gs] + [got["h"][str(k)] for k in want.hs])
    assert np.allclose(own, want.u, atol=1e-6)
    # no nearby variances have a higher restricted likelihood
    for name, by in (("g", 1.05), ("g", 0.95), ("h", 1.05), ("h", 0.95)):
        moved = {k: v * by if k == name else v for k, v in fit.covariances.items()}
        assert Dense(rows, moved, fit.residual, slopes).reml > want.reml - 1e-9
    assert Dense(rows, fit.covariances, fit.residual * 1.02, slopes).reml > want.reml - 1e-9

    # predictions of rows, an unseen level among them
    seen = {(r.g, r.h, r.x): r for r in fit.predict(df.unionByName(spark.createDataFrame([(999, 3, 0.25, "b", 1.0)], SCHEMA)), "est", "pop", "res").collect()}
    fitted = want.x @ want.beta + want.z @ want.u
    for k in (0, 13, 500):
        r = seen[rows[k][:3]]
        assert r.est == pytest.approx(fitted[k], abs=1e-6) and r.pop == pytest.approx(want.x[k] @ want.beta, abs=1e-6)
        assert r.res == pytest.approx((rows[k][4] - fitted[k]) / np.sqrt(fit.residual), abs=1e-6)
    x = np.array([1, 0.25, 1.0])
    assert seen[999, 3, 0.25].est == pytest.approx(x @ want.beta + got["h"]["3"][0], abs=1e-6)

    # intervals for the population, for a level of either term, and for an unseen level
    grid = spark.createDataFrame([(7, 3, 0.25, "b", 0.0), (999, 3, 0.25, "b", 0.0)], SCHEMA)
    for group in (None, "g", "h"):
        for r in fit.predict_interval(grid, group).collect():
            z = np.zeros(len(want.u))
            extra = 0.0
            if group == "g" and r.g == 7:
                at = want.d * want.gs.index(7)
                z[at:at + want.d] = [1, 0.25][:want.d]
            elif group == "g":
                tail = np.array([1, 0.25][:want.d])
                extra = tail @ fit.covariances["g"] @ tail
            elif group == "h":
                z[want.d * len(want.gs) + want.hs.index(3)] = 1
            assert r.estimate == pytest.approx(x @ want.beta + z @ want.u, abs=1e-6)
            se = np.sqrt(want.error(x, z) + extra)
            assert r.std_error == pytest.approx(se, rel=1e-5) and r.upr - r.lwr == pytest.approx(2 * 1.96 * se, rel=1e-4)


def test_two_large_terms(spark):
    """Both terms too large for the driver: conjugate gradients, variances with the stated probes."""
    rows = _crossed_rows(500, 25, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # many short jobs on few rows
    args = (df, "y", [("x",), ("f",)], (mixed.RandomTerm("g"), mixed.RandomTerm("h")), {"f": ["a", "b"]})
    dense, fit = mixed.fit_mixed(*args), mixed.fit_mixed(*args, max_levels=10, probes=40, tol=5e-3)
    assert fit.iterations < 20
    for g in ("g", "h"):
        assert fit.covariances[g][0, 0] == pytest.approx(dense.covariances[g][0, 0], rel=0.05)
    assert fit.residual == pytest.approx(dense.residual, rel=0.01)
    # at its own variances everything but the determinants is exact
    want = _dense_of(rows, fit)
    assert np.allclose(fit.beta, want.beta, atol=1e-6) and np.allclose(fit.cov, want.cov, rtol=1e-4)
    got = fit.effects
    own = np.concatenate([got["g"][str(k)] for k in want.gs] + [got["h"][str(k)] for k in want.hs])
    assert np.allclose(own, want.u, atol=1e-5)
    assert 0 < fit.deviance_error < 2 and abs(fit.deviance_reml - want.reml) < 5 * fit.deviance_error + 0.01
    est = {(r.g, r.h, r.x): r.estimate for r in fit.predict(df).collect()}
    assert est[rows[5][:3]] == pytest.approx((want.x @ want.beta + want.z @ want.u)[5], abs=1e-5)
    with pytest.raises(ValueError, match="several large terms"):
        fit.predict_interval(df, "g")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_comparison_of_fits(spark):
    rows = _crossed_rows(400, 15, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    x, y = np.array([[1, r[2], r[3] == "b"] for r in rows], float), np.array([r[4] for r in rows])
    ols = L.fit_ols(df, "y", [("x",), ("f",)], ["f"])
    fit = mixed.fit_mixed(df, "y", [("x",), ("f",)], (mixed.RandomTerm("g"), mixed.RandomTerm("h")), {"f": ["a", "b"]})
    out = {r.model: r for r in comparison.compare_fits(spark, {"line": ols, "mixed": fit}).collect()}
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss, n, p = ((y - x @ b) ** 2).sum(), len(y), 3
    s2 = rss / (n - p)
    reml = -((n - p) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(x.T @ x)[1]) / 2
    assert out["line"].log_lik == pytest.approx(-n / 2 * (np.log(2 * np.pi * rss / n) + 1)) and out["line"].log_lik_reml == pytest.approx(reml)
    assert (out["line"].df, out["mixed"].df) == (4, 6)
    assert out["mixed"].aic_reml == pytest.approx(_dense_of(rows, fit).reml + 12, abs=1e-6)
    assert min(r.delta_aic for r in out.values()) == 0 and sum(r.weight for r in out.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="rows"):
        comparison.compare_fits(spark, {"line": ols, "part": L.fit_ols(df.where("g > 3"), "y", [("x",)])})
