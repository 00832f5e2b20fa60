"""Gaussian mixed models by restricted likelihood on aggregated cross products.

The rows are first reduced to moments per combination of factor levels, pair products of design
columns are formed inside those few rows and summed; at most (columns)^2 numbers reach the driver.

With many random levels the largest term stays on the cluster: one row per level holds its products, each round sums what the
levels contribute to the equations of the other columns and to the gradient, and only those sums reach the driver. The
estimates are the same either way: the deviance descends (:func:`descend`) over Cholesky factors of the covariances in units
of the residual variance, in which a variance of 0 is a point like any other. If several terms are large, all levels stay on
the cluster, the equations are solved by conjugate gradients (:mod:`crossed`), and the rounds are those of EM, accelerated
(:class:`Accelerated`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, written
from ..functions.fixed_values import Z95
from .linear import DesignColumn, design, fixed_part, quadratic_form

#: Columns of the equations that the driver solves; beyond it the largest random term is eliminated on the cluster, and if
#: that is not enough, every random level stays there.
MAX_LEVELS = 2_000
#: Share of the residual variance at which a variance that goes on falling is taken for 0, with several large terms.
ZERO = 1e-6
#: Numbers a task holds at a time when it works on levels.
_CHUNK = 2_000_000


@dataclass(frozen=True)
class RandomTerm:
    """Random intercept per level of ``group``, with correlated random slopes."""
    group: str
    slopes: tuple[str, ...] = ()


def cross_products(df: DataFrame, response: str, fixed: Sequence[DesignColumn],
                   random: Sequence[RandomTerm]) -> DataFrame:
    """(i, j, v): sum over rows of column i times column j, for i <= j by name.

    Columns are the fixed design, ``group=level`` and ``group:slope=level``, and the response.
    Centered or standardized numerics keep the sums well conditioned.
    """
    factors = list(dict.fromkeys([f for c in fixed for f, _ in c.levels] + [t.group for t in random]))
    numerics = list(dict.fromkeys([c.numeric for c in fixed if c.numeric]
                                  + [s for t in random for s in t.slopes] + [response]))
    k = len(numerics) + 1
    x = df.select(*factors, *[F.col(c).cast("double").alias(c) for c in numerics]).dropna()
    base = {None: 0, **{c: i + 1 for i, c in enumerate(numerics)}}
    val = [F.lit(1.0), *[F.col(c) for c in numerics]]
    sums = [F.sum(val[i] * val[j]).alias(f"_{i}_{j}") for i in range(k) for j in range(i, k)]
    cells = x.groupBy(*factors).agg(*sums)

    def entry(name, b, cond=None):
        e = F.struct(name.alias("name"), F.lit(b).alias("b"))
        return e if cond is None else F.when(cond, e)

    entries = []
    for c in fixed:
        cond = None
        for f, v in c.levels:
            cond = (F.col(f) == v) if cond is None else cond & (F.col(f) == v)
        entries.append(entry(F.lit(f"fixed {c.name}"), base[c.numeric], cond))
    for t in random:
        level = F.col(t.group).cast("string")
        entries.append(entry(F.concat(F.lit(f"{t.group}="), level), 0))
        for s in t.slopes:
            entries.append(entry(F.concat(F.lit(f"{t.group}:{s}="), level), base[s]))
    entries.append(entry(F.lit("response"), base[response]))
    m = F.array(*[F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    cols = F.filter(F.array(*entries), lambda e: e.isNotNull())
    pairs = F.flatten(F.transform("_e", lambda a: F.transform(
        F.filter("_e", lambda b: b["name"] >= a["name"]),
        lambda b: F.struct(a["name"].alias("i"), b["name"].alias("j"),
                           F.get("_m", a["b"] * k + b["b"]).alias("v")))))
    return (cells.select(cols.alias("_e"), m.alias("_m")).select(F.inline(pairs))
            .groupBy("i", "j").agg(F.sum("v").alias("v")))


@dataclass
class MixedFit:
    response: str
    columns: list[DesignColumn]
    beta: np.ndarray
    #: covariance of the fixed coefficients
    cov: np.ndarray
    covariances: dict[str, np.ndarray]
    residual: float
    random: tuple[RandomTerm, ...]
    iterations: int
    n: int
    #: -2 log likelihood, without and with restriction; their standard error where determinants are estimated by probes
    deviance: float
    deviance_reml: float
    deviance_error: float
    #: group -> levels with effects ``u``, prediction-error covariance ``pev`` and covariance with the fixed coefficients
    #: ``cov`` (both as rows, in units of the residual variance); null where they are not known
    levels: dict[str, DataFrame]
    #: the term that was eliminated on the cluster, if one was
    absorbed: AbsorbedTerm | None = None

    @property
    def fixed(self) -> dict[str, tuple[float, float]]:
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        return {c.name: (float(b), float(e)) for c, b, e in zip(self.columns, self.beta, se)}

    @property
    def effects(self) -> dict[str, dict[str, np.ndarray]]:
        """All effects on the driver; meant for small groupings."""
        return {g: {r["level"]: np.array(r["u"]) for r in t.select("level", "u").collect()} for g, t in self.levels.items()}

    @property
    def n_parameters(self) -> int:
        return len(self.beta) + 1 + sum((1 + len(t.slopes)) * (2 + len(t.slopes)) // 2 for t in self.random)

    @property
    def log_lik(self) -> float:
        return -self.deviance / 2

    @property
    def log_lik_reml(self) -> float:
        return -self.deviance_reml / 2

    def table(self, spark: SparkSession) -> DataFrame:
        """All estimates: fixed coefficients, variance components and predicted effects."""
        rows = [("fixed", t, "", b, se) for t, (b, se) in self.fixed.items()]
        for t in self.random:
            names = ("(Intercept)", *t.slopes)
            g = self.covariances[t.group]
            rows += [("variance", t.group, a if a == b else f"{a},{b}", float(g[i, j]), None)
                     for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        rows.append(("variance", "residual", "", self.residual, None))
        out = spark.createDataFrame(
            rows, "kind string, term string, part string, estimate double, std_error double")
        for t in self.random:
            names = F.array(*[F.lit(a) for a in ("(Intercept)", *t.slopes)])
            out = out.unionByName(
                self.levels[t.group].select(
                    F.lit("effect").alias("kind"), F.concat(F.lit(f"{t.group}="), "level").alias("term"),
                    F.posexplode("u").alias("_k", "estimate"))
                .select("kind", "term", F.get(names, F.col("_k")).alias("part"), "estimate",
                        F.lit(None).cast("double").alias("std_error")))
        return out

    def _with_levels(self, df: DataFrame, group: str, *what: str) -> DataFrame:
        """The effects of a row's level as columns ``_u_<group>`` and so on, by a join; NULL for an unseen level."""
        own = self.levels[group].select(F.col("level").alias("_level"), *[F.col(w).alias(f"_{w}_{group}") for w in what])
        return df.join(own, F.col(group).cast("string") == F.col("_level"), "left").drop("_level")

    def predict(self, df: DataFrame, name: str = "estimate", population: str | None = None, residual: str | None = None) -> DataFrame:
        """Fitted values with the effects of the row's own levels; those of unseen levels are 0.

        Optionally the population value without any effects, and the residual in units of its standard deviation.
        """
        base = fixed_part(self.columns, self.beta)
        out, value = df, base
        for t in self.random:
            out = self._with_levels(out, t.group, "u")
            own = F.col(f"_u_{t.group}")
            for k, c in enumerate((None, *t.slopes)):
                part = F.get(own, F.lit(k))
                value = value + F.coalesce(part if c is None else part * F.col(c).cast("double"), F.lit(0.0))
        out = out.withColumn(name, value)
        if population:
            out = out.withColumn(population, base)
        if residual:
            out = out.withColumn(residual, (F.col(self.response) - F.col(name)) / float(np.sqrt(self.residual)))
        return out.drop(*[f"_u_{t.group}" for t in self.random])

    def predict_interval(self, df: DataFrame, group: str | None = None, name: str = "estimate") -> DataFrame:
        """Estimate, standard error and 95 % interval of the mean, for the population or for the row's level of ``group``
        (the other random terms at 0). An unseen level has effect 0 and the whole variance of its term."""
        x = F.array(*[c.expr() for c in self.columns])
        out = df.withColumn("_x", x)
        value, variance = fixed_part(self.columns, self.beta), quadratic_form(F.col("_x"), self.cov)
        if group is not None:
            t = next(t for t in self.random if t.group == group)
            if self.levels[group].where("pev IS NULL").limit(1).count():
                raise ValueError("several large terms: error variances of single levels are not known")
            out = self._with_levels(out, group, "u", "pev", "cov")
            z = [F.lit(1.0), *[F.col(c).cast("double") for c in t.slopes]]
            d, p, s2 = len(z), len(self.columns), self.residual
            u, pev, cov = (F.col(f"_{w}_{group}") for w in ("u", "pev", "cov"))
            value = value + F.coalesce(sum((F.get(u, F.lit(k)) * z[k] for k in range(d)), F.lit(0.0)), F.lit(0.0))
            known = sum((F.get(pev, F.lit(i * d + j)) * z[i] * z[j] for i in range(d) for j in range(d)), F.lit(0.0))
            dot = lambda k: F.aggregate(
                F.zip_with(F.slice(cov, k * p + 1, p), F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            known = known + 2 * sum((dot(k) * z[k] for k in range(d)), F.lit(0.0))
            prior = sum((F.lit(float(self.covariances[group][i, j])) * z[i] * z[j] for i in range(d) for j in range(d)), F.lit(0.0))
            variance = variance + F.when(pev.isNull(), prior).otherwise(s2 * known)
        out = out.withColumns({name: value, "std_error": F.sqrt(F.greatest(variance, F.lit(0.0)))})
        out = out.drop("_x", *([f"_{w}_{group}" for w in ("u", "pev", "cov")] if group else []))
        return out.withColumns({"lwr": F.col(name) - Z95 * F.col("std_error"), "upr": F.col(name) + Z95 * F.col("std_error")})


# ---- rounds -----------------------------------------------------------------------------------

@dataclass
class Round:
    """What one solution of the equations says at given variances."""

    beta: np.ndarray
    inverse: np.ndarray           # block of the fixed columns in the inverse of the equations
    second: list[np.ndarray]      # per term, mean expected squares of the effects: the next variances
    explained: float              # solution times right-hand side
    logdet: float                 # of the equations
    logdet_error: float = 0.0


class Accelerated:
    """Anderson mixing of the rounds, on the logarithms of variances and Cholesky factors.

    A round maps variances to better ones; the next ones are the mixture of the last few results whose steps
    cancel best. A step that grew falls back to the plain result. Numbers that are held (variances at 0) take no part.
    """

    def __init__(self):
        self.at, self.to, self.last, self.held = [], [], np.inf, None

    @staticmethod
    def flat(s2: float, mats: Sequence[np.ndarray]) -> np.ndarray:
        out = [np.log(s2)]
        for g in mats:
            c = np.linalg.cholesky(g + np.eye(len(g)) * 1e-14 * max(np.trace(g), 1e-300))
            out += [np.log(max(c[i, i], 1e-150)) if i == j else c[i, j] / c[j, j] for i in range(len(c)) for j in range(i + 1)]
        return np.array(out)

    @staticmethod
    def shaped(flat: np.ndarray, sizes: Sequence[int]) -> tuple[float, list[np.ndarray]]:
        at, mats = 1, []
        for d in sizes:
            c = np.zeros((d, d))
            for i in range(d):
                for j in range(i + 1):
                    c[i, j] = np.exp(flat[at]) if i == j else flat[at]
                    at += 1
            for j in range(d):
                c[j + 1:, j] *= c[j, j]
            mats.append(c @ c.T)
        return float(np.exp(flat[0])), mats

    def next(self, at: np.ndarray, to: np.ndarray, held: np.ndarray) -> np.ndarray:
        out, free = np.where(held, at, to), ~held
        at, to = at[free], to[free]
        size = float(np.abs(to - at).max())
        if size > 2 * self.last or self.held is None or (self.held != held).any():
            self.at, self.to = [], []
        self.last, self.held = size, held
        depth = min(5, len(at) + 1)  # more steps than numbers would contradict each other
        self.at, self.to = [*self.at, at][-depth:], [*self.to, to][-depth:]
        if len(self.at) > 1:
            steps = np.array([t - a for a, t in zip(self.at, self.to)])
            weight, *_ = np.linalg.lstsq((steps[1:] - steps[:-1]).T, to - at, rcond=1e-8)
            mixed = to - np.diff(np.array(self.to), axis=0).T @ weight
            out[free] = np.clip(mixed, np.minimum(at, to) - 1, np.maximum(at, to) + 1)
        return out


LEVELS = "level string, u array<double>, pev array<double>, cov array<double>"


class Deviance:
    """Restricted deviance at given factors, profiled over the residual variance, less constants."""

    def __init__(self, value: float, gradient: list[np.ndarray], slopes: list[np.ndarray], sizes: list[np.ndarray], noise: float):
        self.value, self.noise = value, noise
        self.gradient = lower(gradient)   # by the entries of the factors
        self.slopes, self.sizes = slopes, sizes  # by the covariances themselves, and what they are a difference of


def lower(mats: Sequence[np.ndarray]) -> np.ndarray:
    """Entries of lower triangular matrices in a row."""
    return np.concatenate([np.zeros(0), *[m[np.tril_indices(len(m))] for m in mats]])


def triangles(flat: np.ndarray, dims: Sequence[int]) -> list[np.ndarray]:
    out, at = [], 0
    for d in dims:
        m, k = np.zeros((d, d)), d * (d + 1) // 2
        m[np.tril_indices(d)] = flat[at:at + k]
        at += k
        out.append(m)
    return out


def descend(at: Callable[[list[np.ndarray]], Deviance], dims: Sequence[int], rounds: int, tol: float) -> tuple[list[np.ndarray], int]:
    """Factors of least deviance, by quasi-Newton steps (BFGS), and the number of rounds.

    It ends when the next step promises less than ``tol`` of deviance, and takes that step. Values that differ by
    less than their rounding are told apart by their slopes. The gradient also vanishes where a variance is 0 although the likelihood
    rises from there; then the covariance is moved off and the descent goes on.
    """
    x, used, h = lower([np.eye(d) * np.sqrt(0.1) for d in dims]), 1, None
    now = at(triangles(x, dims))
    while used < rounds:
        g = now.gradient
        step = -g * min(1.0, 0.5 * max(1.0, np.linalg.norm(x)) / max(np.linalg.norm(g), 1e-300)) if h is None else -h @ g
        slope = float(g @ step)
        settled = -slope < tol
        t, low, high, best = 1.0, 0.0, np.inf, None
        while not settled and used < rounds:
            new = at(triangles(x + t * step, dims))
            used += 1
            there = float(new.gradient @ step)
            noise = max(now.noise, new.noise)
            if new.value <= now.value + noise:
                best = t, new
            if new.value > now.value + 1e-4 * t * slope + noise or there > 0.9 * -slope:
                high = t
            elif there < 0.9 * slope:
                low = t
            else:
                break
            if high == np.inf:
                t *= 3
            elif high - low < 1e-6 * high or high < 1e-10:
                break  # the values are no better than their rounding
            else:
                middle = t * slope / (slope - there) if there > 0 else (low + high) / 2
                t = min(max(middle, low + 0.1 * (high - low)), low + 0.7 * (high - low))
        if not settled and best is None:
            if h is not None:  # a step along the gradient
                h = None
                continue
            settled = -slope < 1e3 * now.noise
            if not settled:
                break
            step = step * 0
        if not settled:
            t, new = best
            s, dg = t * step, new.gradient - g
            along = float(s @ dg)
            if along > 1e-10 * np.linalg.norm(s) * np.linalg.norm(dg):
                if h is None:
                    h = np.eye(len(x)) * along / float(dg @ dg)
                hg = h @ dg
                h = h + (along + dg @ hg) / along ** 2 * np.outer(s, s) - (np.outer(hg, s) + np.outer(s, hg)) / along
            x, now = x + s, new
            continue
        x = x + step
        moved = _off_zero(triangles(x, dims), now)
        if moved is None:
            return triangles(x, dims), used
        new = at(moved)
        used += 1
        if new.value > now.value - max(tol, now.noise):
            return triangles(x, dims), used
        x, now, h = lower(moved), new, None
    raise RuntimeError(f"no convergence in {used} rounds: the gradient of the deviance is still {np.abs(now.gradient).max():.3g}")


def _off_zero(factors: list[np.ndarray], now: Deviance) -> list[np.ndarray] | None:
    """Factors with more variance in the direction in which the deviance falls most, if it falls in any."""
    found = []
    for k, (q, size) in enumerate(zip(now.slopes, now.sizes)):
        w, v = np.linalg.eigh((q + q.T) / 2)
        around = max(abs(float(v[:, 0] @ size @ v[:, 0])), 1e-300)
        found.append((w[0] / around, k, around, v[:, 0]))
    steepest, k, around, v = min(found, key=lambda x: x[0])
    if steepest > -1e-6:
        return None
    more = factors[k] @ factors[k].T + 0.01 / around * np.outer(v, v)
    more = np.linalg.cholesky(more + np.eye(len(more)) * 1e-14 * np.trace(more))
    return [*factors[:k], more, *factors[k + 1:]]


# ---- the term that stays on the cluster -----------------------------------------------------

def _prefixes(t: RandomTerm) -> list[str]:
    return [f"{t.group}=", *[f"{t.group}:{s}=" for s in t.slopes]]


def _part(name: Column, t: RandomTerm) -> Column:
    """Which part of the term a design column is (0: intercept), null for columns of others."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(k)) for k, p in enumerate(_prefixes(t))], F.lit(None).cast("int"))


def level_blocks(prods: DataFrame, t: RandomTerm, order: Sequence[str]) -> DataFrame:
    """One row per level: products of its parts k with the columns c of ``order``, then with its own parts.

    A level's row has at most parts x (columns + parts) entries, so no row grows with the data.
    """
    i, j = F.col("i"), F.col("j")
    level = F.coalesce(*[F.when(i.startswith(p), i.substr(F.lit(len(p) + 1), F.length(i))) for p in _prefixes(t)])
    both = prods.select("i", "j", "v").union(prods.where("i <> j").select(j.alias("i"), i.alias("j"), "v"))
    # as many names as the driver's equations have columns
    names = prods.sparkSession.createDataFrame([(c, k) for k, c in enumerate(order)], "j string, c int")
    return written(both.where(_part(i, t).isNotNull()).join(F.broadcast(names), "j", "left")
                   .select(level.alias("level"), F.struct(
                       _part(i, t).alias("k"), F.coalesce("c", F.lit(len(order)) + _part(j, t)).alias("c"), "v").alias("e"))
                   .groupBy("level").agg(F.collect_list("e").alias("e")), "level-blocks")


def _over_levels(blocks: DataFrame, d: int, width: int, schema: str,
                 kernel: Callable[[pa.Array, np.ndarray], pa.RecordBatch | np.ndarray]) -> DataFrame:
    """Run a kernel on (levels, parts, columns) arrays; arrays it returns are added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, _CHUNK // (d * width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                k, c, v = lists.flatten().flatten()
                x = np.zeros((len(lists), d, width))
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                x[row, k.to_numpy(), c.to_numpy()] = v.to_numpy()
                out = kernel(part.column(0), x)
                if isinstance(out, np.ndarray):
                    total = out if total is None else total + out
                else:
                    yield out
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return blocks.select("level", "e").mapInArrow(run, schema)


class AbsorbedTerm:
    """Eliminates one random term; q columns and the response remain."""

    def __init__(self, prods: DataFrame, term: RandomTerm, order: Sequence[str]):
        self.term, self.d, self.q = term, 1 + len(term.slopes), len(order)
        self.blocks = level_blocks(prods, term, [*order, "response"])

    def _solved(self, factor: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, ...]]:
        """Inverse of the levels' own equations, with variances of 0 as well, their products with the others, that
        inverse times these, and the factors from whose product with the transposed factor the inverse comes."""
        rest = self.q + 1

        def solved(x: np.ndarray) -> tuple[np.ndarray, ...]:
            inner = factor.T @ x[:, :, rest:] @ factor + np.eye(len(factor))
            half = factor @ np.linalg.inv(inner)
            m = half @ factor.T
            return m, x[:, :, :rest], m @ x[:, :, :rest], half, inner
        return solved

    def _sum(self, kernel: Callable[[pa.Array, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        sums = _over_levels(self.blocks, self.d, self.q + 1 + self.d, "i int, j int, v double", kernel).groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros((size, size))
        for r in sums.collect():  # size^2 numbers
            out[r.i, r.j] = r.v
        return out

    def schur(self, factor: np.ndarray) -> tuple[np.ndarray, float]:
        """What the levels take from the equations of the other columns (the response last), and the log determinant of their own."""
        solved = self._solved(factor)

        def kernel(_, x):
            _, b, mb, _, inner = solved(x)
            out = np.zeros((b.shape[2] + 1,) * 2)
            out[:-1, :-1] = b.reshape(-1, b.shape[2]).T @ mb.reshape(-1, b.shape[2])
            out[-1, -1] = np.linalg.slogdet(inner)[1].sum()
            return out
        out = self._sum(kernel, self.q + 2)
        return out[:-1, :-1], float(out[-1, -1])

    def slopes(self, factor: np.ndarray, sol: np.ndarray, inv: np.ndarray, weight: float) -> tuple[np.ndarray, ...]:
        """Slope of the deviance by the factor (half of it) and by the covariance, and the first part of the latter."""
        solved, d, q = self._solved(factor), self.d, self.q

        def kernel(_, x):
            m, b, _, half, _ = solved(x)
            own = x[:, :, q + 1:]
            left = own @ m - np.eye(d)
            rest = b[:, :, q] - b[:, :, :q] @ sol
            e = -(left @ rest[:, :, None])[:, :, 0]
            s = (half.transpose(0, 2, 1) @ rest[:, :, None])[:, :, 0]
            around = left @ ((b[:, :, :q] @ inv) @ b[:, :, :q].transpose(0, 2, 1))
            size = (-left @ own - around @ left.transpose(0, 2, 1)).sum(axis=0)
            out = np.zeros((2 * d, 2 * d))
            out[:d, :d] = (own @ half + around @ half).sum(axis=0) - weight * (e.T @ s)
            out[:d, d:], out[d:, :d] = size - weight * (e.T @ e), size
            return out
        out = self._sum(kernel, 2 * d)
        return out[:d, :d], out[:d, d:], out[d:, :d]

    def effects(self, factor: np.ndarray, sol: np.ndarray, inv: np.ndarray, p: int) -> DataFrame:
        """Effects of each level, their error covariance, and that with the first p columns."""
        solved, q = self._solved(factor), self.q

        def kernel(levels, x):
            m, _, mb, *_ = solved(x)
            u = mb[:, :, q] - mb[:, :, :q] @ sol
            pev = m + (mb[:, :, :q] @ inv) @ mb[:, :, :q].transpose(0, 2, 1)
            cov = -(mb[:, :, :q] @ inv[:, :p])
            lists = [pa.array(v.reshape(len(u), -1).tolist(), pa.list_(pa.float64())) for v in (u, pev, cov)]
            return pa.RecordBatch.from_arrays([levels, *lists], ["level", "u", "pev", "cov"])
        return written(_over_levels(self.blocks, self.d, q + 1 + self.d, LEVELS, kernel), "effects")


class DriverSystem:
    """Equations whose columns the driver solves, less those of at most one term that stays on the cluster."""

    def __init__(self, prods: DataFrame, fixed: Sequence[DesignColumn], random: Sequence[RandomTerm], big: int | None):
        self.random, self.big = list(random), big
        small = [t for k, t in enumerate(random) if k != big]
        rest = prods if big is None else prods.where(
            _part(F.col("i"), random[big]).isNull() & _part(F.col("j"), random[big]).isNull())
        value = {(x["i"], x["j"]): x["v"] for x in rest.collect()}
        value.update({(j, i): v for (i, j), v in list(value.items())})
        names = {i for i, _ in value}
        fx = [f"fixed {c.name}" for c in fixed]
        self.keys: list[list[str]] = []
        order, at = list(fx), len(fx)
        self.spans: list[list[np.ndarray]] = []
        for t in small:
            prefix = f"{t.group}="
            levels = sorted(s[len(prefix):] for s in names if s.startswith(prefix))
            order += [c for x in levels for c in (f"{t.group}={x}", *[f"{t.group}:{s}={x}" for s in t.slopes])]
            d = 1 + len(t.slopes)
            self.keys.append(levels)
            self.spans.append([np.arange(at + i * d, at + (i + 1) * d) for i in range(len(levels))])
            at += d * len(levels)
        self.p = len(fx)
        self.c0 = np.zeros((len(order), len(order)))
        place = {c: k for k, c in enumerate(order)}
        for (i, j), v in value.items():
            if i in place and j in place:
                self.c0[place[i], place[j]] = v
        self.rhs = np.array([value.get((a, "response"), 0.0) for a in order])
        self.yy = value[("response", "response")]
        self.n = int(round(value[("fixed (Intercept)", "fixed (Intercept)")]))
        self.absorbed = None if big is None else AbsorbedTerm(prods, random[big], order)

    def _small(self) -> list[int]:
        return [k for k in range(len(self.random)) if k != self.big]

    def _times(self, rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
        """Rows over the columns of the equations, times the factors of the levels."""
        out = rows.copy()
        for k, blocks in zip(self._small(), self.spans):
            at = np.array(blocks)
            out[..., at] = rows[..., at] @ factors[k]
        return out

    def _solve(self, factors: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Solve the equations for effects in units of their factors."""
        lhs, right, yy, logdet = self.c0, self.rhs, self.yy, 0.0
        if self.absorbed:
            taken, logdet = self.absorbed.schur(factors[self.big])
            lhs, right, yy = lhs - taken[:-1, :-1], right - taken[:-1, -1], yy - taken[-1, -1]
        half = self._times(lhs, factors)
        inner = self._times(half.T, factors).T
        inner = (inner + inner.T) / 2 + np.diag(np.arange(len(lhs)) >= self.p)
        r, inv = self._times(right, factors), np.linalg.inv(inner)
        s = inv @ r
        s = s + inv @ (r - inner @ s)
        # of second order in the error of the solution
        rss = max(float(yy - 2 * (s @ r) + s @ inner @ s), 1e-15 * self.yy, 1e-300)
        return lhs, right, half, inv, s, rss, logdet + float(np.linalg.slogdet(inner)[1])

    def _effects(self, inv: np.ndarray, s: np.ndarray, factors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        turned = [f.T for f in factors]
        return self._times(self._times(inv, turned).T, turned).T, self._times(s, turned)

    def deviance(self, factors: list[np.ndarray]) -> Deviance:
        lhs, right, half, inv, s, rss, logdet = self._solve(factors)
        free = self.n - self.p
        weight, (whole, sol) = free / rss, self._effects(inv, s, factors)
        e, around, across = right - lhs @ sol, half @ inv, lhs @ whole
        gradient: list[np.ndarray | None] = [None] * len(self.random)
        slopes, sizes = list(gradient), list(gradient)
        for k, blocks in zip(self._small(), self.spans):
            gradient[k] = 2 * sum(around[np.ix_(b, b)] - weight * np.outer(e[b], s[b]) for b in blocks)
            sizes[k] = sum(lhs[np.ix_(b, b)] - across[b] @ lhs[:, b] for b in blocks)
            slopes[k] = sizes[k] - weight * sum(np.outer(e[b], e[b]) for b in blocks)
        if self.absorbed:
            by_factor, slopes[self.big], sizes[self.big] = self.absorbed.slopes(factors[self.big], sol, whole, weight)
            gradient[self.big] = 2 * by_factor
        value = logdet + free * np.log(rss)
        noise = 1e-14 * abs(value) + 1e-14 * weight * self.yy  # of the value, by rounding of the sums it is made of
        return Deviance(value, gradient, slopes, sizes, noise)

    def solved(self, factors: list[np.ndarray]) -> tuple[Round, float]:
        """The solution at the estimates, and the residual variance."""
        _, _, _, inv, s, rss, logdet = self._solve(factors)
        whole, sol = self._effects(inv, s, factors)
        self.solution = (whole, sol, factors[self.big] if self.absorbed else None)
        return Round(sol[:self.p], whole[:self.p, :self.p], [], self.yy - rss, logdet), rss / (self.n - self.p)

    def levels(self, spark: SparkSession) -> dict[str, DataFrame]:
        inv, sol, factor = self.solution
        out = {}
        for k, keys, blocks in zip(self._small(), self.keys, self.spans):
            rows = [(key, sol[b].tolist(), inv[np.ix_(b, b)].ravel().tolist(), inv[b, :self.p].ravel().tolist())
                    for key, b in zip(keys, blocks)]  # at most MAX_LEVELS rows
            out[self.random[k].group] = spark.createDataFrame(rows, LEVELS)
        if self.absorbed:
            out[self.random[self.big].group] = self.absorbed.effects(factor, sol, inv, self.p)
        return out


def fit_mixed(df: DataFrame, response: str, terms: Sequence[tuple[str, ...]],
              random: Sequence[RandomTerm], levels: dict[str, list] | None = None,
              max_iter: int = 500, tol: float = 1e-9, max_levels: int | None = None, probes: int = 16) -> MixedFit:
    """REML. ``levels`` gives the sorted levels of the fixed factors; a row with another level is an error.

    ``tol`` is the deviance that another step may still promise; with several large terms, the share by which a variance may still move.

    Crossed random terms may have any number of levels: up to ``max_levels`` columns are solved on the driver; beyond that the
    largest term is eliminated on the cluster, and if the others are still too many, the equations of all levels are
    solved there by conjugate gradients, with ``probes`` random vectors for the variances.
    """
    from .crossed import CrossedSystem

    limit = MAX_LEVELS if max_levels is None else max_levels
    fixed = design(terms, levels or {})
    for f, known in (levels or {}).items():  # an unlisted level would silently count as the reference
        told = F.concat(F.lit(f"{f}: not among the given levels: "), F.col(f).cast("string"))
        df = df.withColumn(f, F.when(F.col(f).isNull() | F.col(f).isin(list(known)), F.col(f)).otherwise(F.raise_error(told)))
    prods = cut_lineage(cross_products(df, response, fixed, random))
    diagonal = prods.where("i = j")
    sizes = diagonal.agg(*[F.count(_part(F.col("i"), t)).alias(f"_{k}") for k, t in enumerate(random)]).first() if random else []
    big = max(range(len(random)), key=lambda k: sizes[k]) if sum(sizes) > limit else None
    crossed = big is not None and sum(sizes) - sizes[big] > limit
    dims = [1 + len(t.slopes) for t in random]
    if crossed:
        system = CrossedSystem(prods, fixed, random, probes)
        s2, mats, last, it = _accelerated(system, dims, max_iter, tol)
        counts = system.n_effects()
        effects = sum(c * d for c, d in zip(counts, dims))
        inside = sum(c * np.linalg.slogdet(g)[1] for c, g in zip(counts, mats)) + last.logdet - effects * np.log(s2)
    else:
        system = DriverSystem(prods, fixed, random, big)
        factors, it = descend(system.deviance, dims, max_iter, tol) if random else ([], 1)
        last, s2 = system.solved(factors)
        mats, inside = [s2 * f @ f.T for f in factors], last.logdet
    # the log determinant of the covariance of the response is that of the equations
    p, n = len(fixed), system.n
    misfit = (system.yy - last.explained) / s2
    ml = n * np.log(2 * np.pi) + n * np.log(s2) + inside + np.linalg.slogdet(last.inverse)[1] + misfit
    reml = (n - p) * np.log(2 * np.pi) + (n - p) * np.log(s2) + inside + misfit
    return MixedFit(response, fixed, last.beta, last.inverse * s2, {t.group: g for t, g in zip(random, mats)}, s2, tuple(random),
                    it, n, float(ml), float(reml), last.logdet_error, system.levels(df.sparkSession),
                    None if crossed else system.absorbed)


def _accelerated(system: "CrossedSystem", dims: Sequence[int], max_iter: int, tol: float) -> tuple[float, list[np.ndarray], Round, int]:  # noqa: F821
    """Rounds of EM until the variances rest, and the solution there."""
    p, n, yy = system.p, system.n, system.yy
    s2 = max(yy / n, 1e-12)
    mats = [np.eye(d) * s2 / 10 for d in dims]
    mixing, move = Accelerated(), 1.0
    for it in range(1, max_iter + 1):
        system.precision = min(1e-3, max(0.01 * move, 1e-8))
        now = system.round(s2, mats)
        new_s2 = float((yy - now.explained) / (n - p))
        # a single variance that falls below this share of the residual one, and would fall on, counts as 0
        still = [len(g) == 1 and g[0, 0] <= ZERO * s2 * 1.01 and b[0, 0] <= g[0, 0] for g, b in zip(mats, now.second)]
        new = [g if hold else (np.maximum(b, ZERO * s2) if len(g) == 1 else b + np.eye(len(g)) * 1e-14)
               for g, b, hold in zip(mats, now.second, still)]
        # a variance near 0 has settled when it moves little beside the residual one
        move = max([abs(new_s2 / s2 - 1)] + [np.abs(a - b).max() / max(s2, np.abs(b).max()) for a, b in zip(new, mats)])
        if move < tol:
            s2, mats = new_s2, new
            break
        held = np.concatenate([[False], *[np.full(d * (d + 1) // 2, hold) for d, hold in zip(dims, still)]])
        s2, mats = Accelerated.shaped(mixing.next(Accelerated.flat(s2, mats), Accelerated.flat(new_s2, new), held), dims)
        mats = [np.maximum(g, ZERO * s2) if len(g) == 1 else g for g in mats]
    else:
        raise RuntimeError(f"no convergence in {max_iter} rounds: the last step moved a variance by a share of {move:.3g}")
    system.precision = 1e-8
    last = system.round(s2, mats, last=True)
    return s2, mats, last, it
