"""Principal components of standardized columns.

Means, standard deviations and all correlations come from one aggregate; the small correlation
matrix is decomposed on the driver and the scores are a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class PcaFit:
    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray      # one column per component
    variance: np.ndarray      # of every component

    @property
    def proportion(self) -> np.ndarray:
        return self.variance / self.variance.sum()

    def scores(self, df: DataFrame, keep: Sequence[str], k: int | None = None) -> DataFrame:
        k = k or self.loadings.shape[1]
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.sd)]
        pcs = [reduce(lambda a, b: a + b, [F.lit(float(w)) * x for w, x in zip(self.loadings[:, j], z)])
               for j in range(k)]
        return (df.dropna(how="any", subset=self.columns)
                .select(*keep, *[c.alias(f"PC{j + 1}") for j, c in enumerate(pcs)]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f"PC{j + 1}", c, float(self.loadings[i, j]), float(self.proportion[j]))
                for j in range(self.loadings.shape[1]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component string, column string, loading double, proportion double")


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 3) -> PcaFit:
    """Centered and scaled components; each sign makes the largest loading positive."""
    cols = list(cols)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = list(combinations(range(len(cols)), 2))
    row = x.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols)
                  for n, f in (("m", F.avg), ("s", F.stddev_samp))],
                *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    corr = np.eye(len(cols))
    for i, j in pairs:
        corr[i, j] = corr[j, i] = row[f"r{i}_{j}"]
    w, v = np.linalg.eigh(corr)
    w, v = w[::-1], v[:, ::-1]
    for j in range(v.shape[1]):
        # of equal loadings the first decides
        top = int(np.argmax(np.round(np.abs(v[:, j]), 9)))
        v[:, j] *= np.sign(v[top, j])
    return PcaFit(cols, np.array([row[f"m{i}"] for i in range(len(cols))]),
                  np.array([row[f"s{i}"] for i in range(len(cols))]), v[:, :k], w)
