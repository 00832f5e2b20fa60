"""Linear models from moments aggregated on the cluster.

Rows are reduced to one set of moments per combination of factor levels; means and covariances are
merged stably by the engine. The products of design columns are summed from them on the cluster, so
the driver receives one number per pair of columns, whatever the number of combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed_values import Z95
from ..session import written


# ---- terms ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class DesignColumn:
    """Product of level indicators and at most one numeric column."""
    levels: tuple[tuple[str, object], ...]
    numeric: str | None

    @property
    def name(self) -> str:
        parts = ([self.numeric] if self.numeric else []) + [f"{f}[{v}]" for f, v in self.levels]
        return ":".join(parts) or "(Intercept)"

    def expr(self, centers: dict[str, float] | None = None) -> Column:
        base = F.lit(1.0) if self.numeric is None else F.col(self.numeric).cast("double")
        if self.numeric and centers:
            base = base - F.lit(centers[self.numeric])
        for f, v in self.levels:
            base = F.when(F.col(f) == v, base).otherwise(0.0)
        return base


def fixed_part(cols: Sequence[DesignColumn], beta: np.ndarray, centers: dict[str, float] | None = None) -> Column:
    """Design columns times coefficients."""
    return reduce(lambda a, b: a + b, [F.lit(float(b)) * c.expr(centers) for b, c in zip(beta, cols)])


def quadratic_form(x: Column, cov: np.ndarray) -> Column:
    """x' cov x of an array column, as a sum of squares, so rounding cannot make it negative."""
    w, v = np.linalg.eigh(cov)
    root = (v * np.sqrt(np.clip(w, 0, None))).T       # cov = root' root
    rows = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in root])
    dots = F.transform(rows, lambda row: F.aggregate(
        F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z))
    return F.aggregate(dots, F.lit(0.0), lambda s, z: s + z * z)


def crossed(*names: str) -> list[tuple[str, ...]]:
    """All main effects and interactions, as ``a*b*c`` in a formula."""
    return [c for k in range(1, len(names) + 1) for c in combinations(names, k)]


def design(terms: Sequence[tuple[str, ...]], levels: dict[str, list]) -> list[DesignColumn]:
    """Treatment coding: the first sorted level of each factor is the reference."""
    cols = [DesignColumn((), None)]
    for term in terms:
        numeric = [t for t in term if t not in levels]
        factors = [t for t in term if t in levels]
        if len(numeric) > 1:
            raise ValueError(f"products of numeric columns are columns of their own: {term}")
        for vs in product(*[levels[f][1:] for f in factors]):
            cols.append(DesignColumn(tuple(zip(factors, vs)), numeric[0] if numeric else None))
    return list(dict.fromkeys(cols))


# ---- moments --------------------------------------------------------------------------------

def cell_moments(df: DataFrame, factors: Sequence[str], numerics: Sequence[str]) -> DataFrame:
    """n, means (m_x) and population covariances (c_x_y) per combination of factor levels, over
    rows complete in all columns."""
    x = df.select(*factors, *[F.col(c).cast("double").alias(c) for c in numerics]).dropna()
    pairs = [(a, b) for i, a in enumerate(numerics) for b in list(numerics)[i:]]
    return x.groupBy(*factors).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in numerics],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])


def facts_of(cells: DataFrame, factors: Sequence[str], numerics: Sequence[str]) -> tuple[dict[str, list], dict[str, float], int]:
    """Sorted levels of each factor, overall means and the number of rows, in one pass over the cells.

    There are as many levels as the design has columns for them.
    """
    one = cells.agg(F.sum("n").alias("_n"), *[F.collect_set(f).alias(f"_l{i}") for i, f in enumerate(factors)],
                    *[(F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n")).alias(f"_m{i}") for i, c in enumerate(numerics)]).first()
    return ({f: sorted(one[f"_l{i}"]) for i, f in enumerate(factors)}, {c: one[f"_m{i}"] for i, c in enumerate(numerics)}, int(one["_n"] or 0))


def moment(names: Sequence[str], centers: dict[str, float], i: int, j: int) -> Column:
    """Sum over the rows of a cell of (1, x - center, ...)[i] times the same at j."""
    i, j = min(i, j), max(i, j)
    off = lambda k: F.col(f"m_{names[k - 1]}") - F.lit(float(centers[names[k - 1]]))
    if i == 0:
        return F.col("n") * (F.lit(1.0) if j == 0 else off(j))
    return F.col("n") * (F.col(f"c_{names[i - 1]}_{names[j - 1]}") + off(i) * off(j))


def design_sums(cells: DataFrame, cols: Sequence[DesignColumn], base: dict, size: int, response: int,
                kinds: dict[str, Callable[[int, int], Column]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, kinds): products of design columns i <= j, summed over all cells on the cluster.

    The last index stands for the response. ``kinds`` gives the product of two base columns within a cell.
    """
    entries = []
    for i, c in enumerate(cols):
        e = F.struct(F.lit(i).alias("i"), F.lit(base[c.numeric]).alias("b"))
        on = [F.col(f).eqNullSafe(F.lit(v)) for f, v in c.levels]
        entries.append(F.when(reduce(lambda x, y: x & y, on), e) if on else e)
    entries.append(F.struct(F.lit(len(cols)).alias("i"), F.lit(response).alias("b")))
    flat = {k: F.array(*[f(i, j) for i in range(size) for j in range(size)]) for k, f in kinds.items()}
    x = cells.select(*keys, *[v.alias(k) for k, v in flat.items()], F.array_compact(F.array(*entries)).alias("_e"))
    # the pairs of a cell are formed within its row and unfolded once
    pairs = F.flatten(F.transform("_e", lambda a: F.transform(
        F.filter("_e", lambda b: b["i"] >= a["i"]),
        lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"),
                           *[F.get(F.col(k), a["b"] * size + b["b"]).alias(k) for k in kinds]))))
    return x.select(*keys, F.inline(pairs)).groupBy(*keys, "i", "j").agg(*[F.sum(k).alias(k) for k in kinds])


def square(rows, kind: str, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X, X'y and y'y from the summed products."""
    full = np.zeros((p + 1, p + 1))
    for x in rows:
        full[x["i"], x["j"]] = full[x["j"], x["i"]] = x[kind]
    return full[:p, :p], full[:p, p], float(full[p, p])


def independent(xx: np.ndarray) -> list[int]:
    """Columns that are not combinations of earlier ones; combinations of levels that never occur are left out."""
    kept: list[int] = []
    for i in range(len(xx)):
        rest = xx[i, i]
        if kept and rest > 0:
            v = xx[kept, i]
            rest -= v @ np.linalg.solve(xx[np.ix_(kept, kept)], v)
        if rest > 1e-9 * max(xx[i, i], 1e-300):
            kept.append(i)
    return kept


def solved(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients (0 for aliased columns), inverse of X'X in the same place, and the kept columns."""
    kept = independent(xx)
    beta, inverse = np.zeros(len(xx)), np.zeros_like(xx)
    own = np.ix_(kept, kept)
    beta[kept], inverse[own] = np.linalg.solve(xx[own], xy[kept]), np.linalg.inv(xx[own])
    return beta, inverse, kept


# ---- fits -----------------------------------------------------------------------------------

@dataclass
class LinearFit:
    response: str
    columns: list[DesignColumn]
    beta: np.ndarray          # for columns centered at ``centers``
    cov: np.ndarray
    sigma2: float
    n: int
    rss: float
    centers: dict[str, float]
    extra: dict[str, float] = field(default_factory=dict)
    aliased: frozenset[int] = frozenset()   # columns without an estimate
    n_correlations: int = 0
    deviance: float = float("nan")          # -2 log likelihood
    deviance_reml: float = float("nan")

    @property
    def n_parameters(self) -> int:
        """Estimated coefficients, correlations and the error variance."""
        return len(self.columns) - len(self.aliased) + self.n_correlations + 1

    @property
    def log_lik(self) -> float:
        return -self.deviance / 2

    @property
    def log_lik_reml(self) -> float:
        return -self.deviance_reml / 2

    def _uncentered(self) -> np.ndarray:
        """Map from coefficients of centered columns to those of the columns as given."""
        t = np.eye(len(self.columns))
        at = {(c.levels, c.numeric): i for i, c in enumerate(self.columns)}
        for (levels, numeric), i in at.items():
            if numeric:
                t[at[(levels, None)], i] -= self.centers[numeric]
        return t

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Term, estimate, standard error and 95 % interval; NULL for a column that others determine."""
        t = self._uncentered()
        b, se = t @ self.beta, np.sqrt(np.clip(np.diag(t @ self.cov @ t.T), 0, None))
        rows = [(c.name, None, None, None, None) if i in self.aliased else
                (c.name, float(x), float(s), float(x - Z95 * s), float(x + Z95 * s))
                for i, (c, x, s) in enumerate(zip(self.columns, b, se))]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, lwr double, upr double")

    def fitted(self) -> Column:
        return fixed_part(self.columns, self.beta, self.centers)

    def predict(self, df: DataFrame, name: str = "estimate", residual: str | None = None) -> DataFrame:
        """Fitted values as one projection; optionally the residual in units of sigma."""
        out = df.withColumn(name, self.fitted())
        if residual:
            out = out.withColumn(residual, (F.col(self.response) - F.col(name)) / float(np.sqrt(self.sigma2)))
        return out

    def predict_interval(self, df: DataFrame, name: str = "estimate") -> DataFrame:
        """Fitted values with standard error and 95 % interval of the mean."""
        x = F.array(*[c.expr(self.centers) for c in self.columns])
        out = df.withColumn(name, self.fitted()).withColumn("_x", x)
        out = out.withColumn("std_error", F.sqrt(quadratic_form(F.col("_x"), self.cov))).drop("_x")
        return out.withColumns({"lwr": F.col(name) - Z95 * F.col("std_error"),
                                "upr": F.col(name) + Z95 * F.col("std_error")})


def _roles(df, response, terms, factors):
    names = list(dict.fromkeys(t for term in terms for t in term))
    numerics = [c for c in names if c not in factors] + [response]
    return numerics


def fit_ols(df: DataFrame, response: str, terms: Sequence[tuple[str, ...]],
            factors: Sequence[str] = ()) -> LinearFit:
    """Least squares for ``response ~ terms``; terms are tuples of factors and at most one numeric.

    Products of design columns are summed on the cluster over any number of factor combinations; the driver
    receives one number per pair of columns.
    """
    numerics = _roles(df, response, terms, factors)
    cells = written(cell_moments(df, factors, numerics), "moments")
    levels, centers, n = facts_of(cells, factors, numerics)
    cols = design(terms, levels)
    base = {None: 0, **{c: i + 1 for i, c in enumerate(numerics)}}
    p, y = len(cols), len(numerics)
    sums = design_sums(cells, cols, base, y + 1, y, {"v": lambda i, j: moment(numerics, centers, i, j)}).collect()
    xx, xy, yy = square(sums, "v", p)
    beta, inverse, kept = solved(xx, xy)
    rss, rank = float(yy - beta @ xy), len(kept)
    sigma2 = rss / (n - rank)
    fit = LinearFit(response, cols, beta.copy(), inverse * sigma2, sigma2, n, rss, centers,
                    aliased=frozenset(range(p)) - frozenset(kept))
    fit.beta[0] += centers[response]      # the response was centered too
    fit.extra = {"r2": 1 - rss / yy, "aic": n * np.log(2 * np.pi * rss / n) + n + 2 * (rank + 1)}
    fit.deviance = float(n * (np.log(2 * np.pi * rss / n) + 1))
    fit.deviance_reml = float((n - rank) * (np.log(2 * np.pi * sigma2) + 1) + np.linalg.slogdet(xx[np.ix_(kept, kept)])[1])
    return fit


def value_grid(df: DataFrame, focal: str, held: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """``steps`` values of the focal column from its minimum to its maximum, others at their mean."""
    one = df.agg(F.min(focal).cast("double").alias("_lo"), F.max(focal).cast("double").alias("_hi"),
                 *[F.avg(h).alias(h) for h in held])
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return one.withColumn("step", step).select(
        "step", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / float(steps - 1)).alias(focal), *held)
