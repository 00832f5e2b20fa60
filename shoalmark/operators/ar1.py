"""Regression with AR(1) errors within series.

The whitened cross products for any correlation follow from the moments of (current, previous)
values per gap, so the data is read once and the likelihood is then profiled on a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .linear import (LinearFit, cell_moments, design, design_sums, facts_of, independent, moment, square,
                     _roles)
from .series import previous


def ar1_moments(df: DataFrame, response: str, numerics: Sequence[str], factors: Sequence[str],
                series: Sequence[str], time: str, checked: bool = False) -> DataFrame:
    """Moments per (factor levels, gap) of the values and, after the first of a series, of the
    previous values too. Factors must be constant within a series."""
    cols = [*numerics, response]
    keep = df.select(*dict.fromkeys([*series, time, *factors, *cols])).dropna()
    lagged = previous(keep, series, time, cols, checked=checked)
    first = lagged.where("gap IS NULL").withColumns({f"prev_{c}": F.lit(0.0) for c in cols})
    rest = lagged.where("gap IS NOT NULL")
    both = first.withColumn("gap", F.lit(0)).unionByName(rest.withColumn("gap", F.col("gap").cast("int")))
    return cell_moments(both, [*factors, "gap"], [*cols, *[f"prev_{c}" for c in cols]])


def fit_gls_ar1(df: DataFrame, response: str, terms: Sequence[tuple[str, ...]], factors: Sequence[str],
                series: Sequence[str], time: str, checked: bool = False) -> LinearFit:
    """REML fit; correlation phi^gap between neighbours of a series. ``extra`` holds phi.

    phi lies in the open interval (-1, 1); a negative phi alternates its sign with the gap.
    """
    cols_n = _roles(df, response, terms, factors)
    numerics = cols_n[:-1]
    cells = written(ar1_moments(df, response, numerics, factors, series, time, checked), "moments")
    levels, centers, n = facts_of(cells, factors, cols_n)
    cols = design(terms, levels)
    both = [*cols_n, *[f"prev_{c}" for c in cols_n]]
    all_centers = {**centers, **{f"prev_{c}": centers[c] for c in cols_n}}
    k, p, y = len(cols_n) + 1, len(cols), len(cols_n)
    base = {None: 0, **{c: i + 1 for i, c in enumerate(numerics)}}
    m = lambda i, j: moment(both, all_centers, i, j)
    before = lambda i: i + k - 1 if i else 0  # noqa: E731  the intercept is its own previous value
    kinds = {"cc": m, "cp": lambda i, j: m(i, before(j)) + m(j, before(i)), "pp": lambda i, j: m(before(i), before(j))}
    by_gap: dict[int, list] = {}
    # p^2 numbers per gap; the product of the intercept with itself is the number of rows
    for x in design_sums(cells, cols, base, k, y, {**kinds, "n": lambda i, j: F.col("n").cast("double")}, ["gap"]).collect():
        by_gap.setdefault(x["gap"], []).append(x)
    counts = {gap: int(next(x["n"] for x in rows if x["i"] == x["j"] == 0)) for gap, rows in by_gap.items()}
    pieces = [(gap, counts[gap], *[square(rows, kind, p) for kind in kinds]) for gap, rows in sorted(by_gap.items())]

    def cross(phi):
        xx, xy, yy, logdet = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for gap, cnt, cc, cp, pp in pieces:
            rho = phi ** gap if gap else 0.0
            if gap:
                logdet += cnt * np.log1p(-rho * rho)
            w = [(c - rho * x + rho * rho * q) / (1 - rho * rho) for c, x, q in zip(cc, cp, pp)]
            xx, xy, yy = xx + w[0], xy + w[1], yy + w[2]
        return xx[own], xy[kept], yy, logdet

    kept = independent(sum(cc[0] for _, _, cc, _, _ in pieces))
    own, rank = np.ix_(kept, kept), len(kept)

    def reml(phi):
        xx, xy, yy, logdet = cross(phi)
        rss = yy - xy @ np.linalg.solve(xx, xy)
        return -(n - rank) / 2 * np.log(rss / (n - rank)) - logdet / 2 - np.linalg.slogdet(xx)[1] / 2

    # nested grids around the best value of atanh(phi), so the whole open interval is searched
    lo, hi, points = -9.0, 9.0, 181
    while hi - lo > 1e-7:
        grid = np.linspace(lo, hi, points)
        best = int(np.argmax([reml(np.tanh(g)) for g in grid]))
        lo, hi, points = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)], 21
    phi = float(np.tanh(grid[best]))
    xx, xy, yy, logdet = cross(phi)
    beta = np.linalg.solve(xx, xy)
    rss = float(yy - beta @ xy)
    sigma2 = rss / (n - rank)
    ml = -n / 2 * (np.log(2 * np.pi * rss / n) + 1) - logdet / 2
    every, cov = np.zeros(p), np.zeros((p, p))
    every[kept], cov[own] = beta, np.linalg.inv(xx) * sigma2
    fit = LinearFit(response, cols, every, cov, sigma2, n, rss, centers, aliased=frozenset(range(p)) - frozenset(kept))
    fit.beta[0] += centers[response]
    fit.extra = {"phi": phi, "reml": float(reml(phi)), "aic": float(-2 * ml + 2 * (rank + 2))}
    fit.n_correlations, fit.deviance = 1, float(-2 * ml)
    fit.deviance_reml = float((n - rank) * (np.log(2 * np.pi * sigma2) + 1) + logdet + np.linalg.slogdet(xx)[1])
    return fit
