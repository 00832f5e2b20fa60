"""Comparison of fitted models by likelihood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .linear import LinearFit
from .mixed import MixedFit

SCHEMA = ("model string, n long, df int, log_lik double, log_lik_reml double, aic double, aic_reml double, bic double, "
          "delta_aic double, weight double")


def compare_fits(spark: SparkSession, fits: dict[str, LinearFit | MixedFit], by: str = "ml") -> DataFrame:
    """One row per fit: parameters, log likelihoods, information criteria, and the difference and weight by ``by``.

    Takes least squares, regressions with AR(1) errors and mixed models, which must be fitted to the same number of rows.
    A restricted likelihood (``by="reml"``) compares only models with the same fixed part.
    """
    if len({f.n for f in fits.values()}) > 1:
        raise ValueError("fits of different rows do not compare: " + ", ".join(f"{k} {f.n}" for k, f in fits.items()))
    rows = []
    for name, f in fits.items():
        df = f.n_parameters
        rows.append((name, int(f.n), int(df), float(f.log_lik), float(f.log_lik_reml), float(2 * df - 2 * f.log_lik),
                     float(2 * df - 2 * f.log_lik_reml), float(np.log(f.n) * df - 2 * f.log_lik)))
    aic = np.array([r[6 if by == "reml" else 5] for r in rows])
    delta = aic - aic.min() if len(rows) else aic
    weight = np.exp(-delta / 2) / np.exp(-delta / 2).sum()
    return spark.createDataFrame([(*r, float(d), float(w)) for r, d, w in zip(rows, delta, weight)], SCHEMA)
