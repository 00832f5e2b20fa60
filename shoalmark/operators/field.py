"""Spatial and spatio-temporal effects as shrunken cell means.

Cells and cell-years are independent random intercepts; there is no correlation between
neighbouring cells. Variances come from the one-way analysis-of-variance moments, so the number of
cells is not limited: everything is a chain of aggregates whose global figures are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .linear import fixed_part
from .mixed import MixedFit, RandomTerm, fit_mixed


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, mean and within sum of squares per group."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("ss"))


def roll_up(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of coarser groups from those of finer ones."""
    n, m = F.col("n"), F.col("mean")
    g = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(n * m) / F.sum("n")).alias("mean"),
        F.sum("ss").alias("_ss"), F.sum(n * m * m).alias("_q"))
    return g.select(*keys, "n", "mean", (F.col("_ss") + F.col("_q") - F.col("n") * m * m).alias("ss"))


def variance_components(stats: DataFrame) -> DataFrame:
    """One row: mean, residual variance, between-group variance (not below zero) and their ratio."""
    n, m = F.col("n"), F.col("mean")
    t = stats.agg(F.sum("n").alias("N"), F.count("*").alias("C"), F.sum(n * n).alias("n2"),
                  F.sum("ss").alias("ssw"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"))
    big_n, c = F.col("N"), F.col("C")
    mse = F.try_divide(F.col("ssw"), big_n - c)
    msb = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / big_n, c - 1)
    n0 = F.try_divide(big_n - F.col("n2") / big_n, c - 1)
    between = F.greatest(F.try_divide(msb - mse, n0), F.lit(0.0))
    return t.select((F.col("s1") / big_n).alias("mu"), mse.alias("residual"), between.alias("between"),
                    F.try_divide(between, mse).alias("ratio"))


def shrink(stats: DataFrame, name: str = "effect") -> tuple[DataFrame, DataFrame]:
    """Shrunken deviations of the group means from the overall mean, and the components used."""
    comp = variance_components(stats)
    k = F.col("n") * comp.select("ratio").scalar()
    effect = k / (1 + k) * (F.col("mean") - comp.select("mu").scalar())
    return stats.withColumn(name, effect), comp


def cell_field(df: DataFrame, cell: Sequence[str], time: str, value: str) -> DataFrame:
    """Per (cell, time): overall mean, cell effect, cell-by-time effect and their sum."""
    # the one pass over the rows; everything after it works on the group table
    fine = cut_lineage(group_stats(df, [*cell, time], value))
    cells, comp = shrink(roll_up(fine, cell), "cell_effect")
    mu = comp.select("mu").scalar()
    rest = (fine.join(cells.select(*cell, "cell_effect"), list(cell))
            .withColumn("mean", F.col("mean") - mu - F.col("cell_effect")))
    comp2 = variance_components(rest)
    k = F.col("n") * comp2.select("ratio").scalar()
    out = rest.withColumn("time_effect", k / (1 + k) * F.col("mean"))
    return out.select(*cell, time, mu.alias("mu"), "cell_effect", "time_effect",
                      (mu + F.col("cell_effect") + F.col("time_effect")).alias("est"))


def predict_field(grid: DataFrame, fit: DataFrame, cell: Sequence[str], time: str) -> DataFrame:
    """Predictions on a grid replicated over time; effects of unseen cells and times are 0."""
    cells = fit.groupBy(*cell).agg(F.max("cell_effect").alias("_c"))
    mu = fit.agg(F.max("mu").alias("mu")).scalar()
    out = (grid.join(cells, list(cell), "left")
           .join(fit.select(*cell, time, F.col("time_effect").alias("_t")), [*cell, time], "left"))
    est = mu + F.coalesce("_c", F.lit(0.0)) + F.coalesce("_t", F.lit(0.0))
    return out.withColumn("est", est).drop("_c", "_t")


# ---- with covariates --------------------------------------------------------------------------

@dataclass
class CovariateField:
    """Fixed covariates, a random effect per cell and one per cell and time nested in it."""
    fit: MixedFit
    cell: tuple[str, ...]
    time: str
    seen: DataFrame

    def estimates(self, spark: SparkSession) -> DataFrame:
        """Fixed coefficients and the three variances."""
        rows = [("fixed", t, b, se) for t, (b, se) in self.fit.fixed.items()]
        rows += [("variance", name, float(self.fit.covariances[g][0, 0]), None) for name, g in (("cell", _CELL), ("cell by time", _CELL_TIME))]
        rows.append(("variance", "residual", self.fit.residual, None))
        return spark.createDataFrame(rows, "kind string, term string, estimate double, std_error double")

    def _effects(self, df: DataFrame, cell_name: str, time_name: str) -> DataFrame:
        for group, name in ((_CELL, cell_name), (_CELL_TIME, time_name)):
            own = self.fit.levels[group].select(F.col("level").alias(group), F.get("u", F.lit(0)).alias(name))
            df = df.join(own, group, "left")
        return df

    def effects(self) -> DataFrame:
        """Both effects of every cell and time that was fitted."""
        return self._effects(self.seen, "cell_effect", "time_effect").drop(_CELL, _CELL_TIME)

    def predict(self, grid: DataFrame, name: str = "est") -> DataFrame:
        """Predictions on a grid with the covariates; effects of unseen cells and times are 0."""
        out = self._effects(_keyed(grid, self.cell, self.time), "_c", "_t")
        fixed = fixed_part(self.fit.columns, self.fit.beta)
        value = fixed + F.coalesce("_c", F.lit(0.0)) + F.coalesce("_t", F.lit(0.0))
        return out.withColumn(name, value).drop(_CELL, _CELL_TIME, "_c", "_t")


_CELL, _CELL_TIME = "_cell", "_cell_time"


def _keyed(df: DataFrame, cell: Sequence[str], time: str) -> DataFrame:
    """Text keys of a cell and of a cell at a time; a missing part makes a key that no cell has."""
    key = F.to_json(F.struct(*cell))
    return df.withColumns({_CELL: key, _CELL_TIME: F.to_json(F.struct(*cell, time))})


def fit_covariate_field(df: DataFrame, cell: Sequence[str], time: str, value: str, terms: Sequence[tuple[str, ...]],
                        levels: dict[str, list] | None = None, **how) -> CovariateField:
    """Field with covariates by restricted likelihood, for any number of cells.

    ``terms`` and ``levels`` are as in :func:`fit_mixed`; polynomials of a depth are columns of their own. The rows are
    reduced to products per cell and time; cells and cell-times stay on the cluster when there are many of them.
    """
    rows = _keyed(df.dropna(subset=[*cell, time]), cell, time)
    fit = fit_mixed(rows, value, terms, (RandomTerm(_CELL), RandomTerm(_CELL_TIME)), levels, **how)
    seen = cut_lineage(rows.select(*cell, time, _CELL, _CELL_TIME).distinct())
    return CovariateField(fit, tuple(cell), time, seen)
