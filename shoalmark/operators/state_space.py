"""Deterministic parts of the hierarchical AR(1) model, and posterior draws as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import normal_logpdf


def state_space_mean(panel: DataFrame, regions: DataFrame, params: dict[str, float], region: str = "region",
                     climate: str | None = None, harvest: str = "harvest", temp: str = "temp") -> DataFrame:
    """mu_pop and mu_r of each (year, region); ``regions`` holds the deviation gamma per region."""
    pop = F.lit(float(params["alpha_0"]))
    if climate:
        pop = pop + params["beta_climate"] * F.col(climate)
    mean = (pop + F.col("gamma") + params["beta_harvest"] * F.col(harvest)
            + params["beta_temp"] * F.col(temp))
    return (panel.join(regions.select(region, "gamma"), region)
            .withColumns({"mu_pop": pop, "mu_r": mean}).drop("gamma"))


def log_likelihood(df: DataFrame, y: str, state: str, sd: float, name: str = "log_lik") -> DataFrame:
    """Pointwise log density, one value per row."""
    return df.withColumn(name, normal_logpdf(y, state, F.lit(float(sd))))


def recover_labels(draws: DataFrame, levels: DataFrame, index: str, code: str, label: str) -> DataFrame:
    """Replace the integer index of draws by the label it stands for."""
    return draws.join(levels.select(F.col(code).cast("bigint").alias(index), F.col(label)), index, "left")
