"""Indicator tables and inputs of the state-space model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as K
from ..operators.aggregates import standardize
from ..operators.ordering import order_groups_by_mean
from ..operators.reshape import pivot_mean_fill, pivot_values
from ..session import cut_lineage


def indicator_series(table: DataFrame, var: str, areas: DataFrame | None = None) -> DataFrame:
    """Rows of one indicator, of the wanted areas, with a numeric time and the rank of the area by its mean value.

    ``table(time, var, value, area)``; a time label like ``week_12`` gives 12.
    """
    rows = table.where(F.col("var") == var)
    if areas is not None:
        rows = rows.join(areas.select("area"), "area", "left_semi")
    rows = rows.withColumn("time_point", K.word("time", 1, "_").try_cast("double"))
    return rows.join(order_groups_by_mean(rows, "area", "value", "facet").drop("mean_value"), "area")


def state_space_inputs(eav: DataFrame, metrics: Sequence[str], regions: Sequence, since: int | None = None) -> DataFrame:
    """Year x region matrices side by side, one row per year.

    ``eav(year, region, metric, value)``. Absent cells of temperature and response take the overall
    mean, absent cells of the standardized harvest are 0; ``x0_r`` repeats the response of the first
    year as the starting state of each region.
    """
    eav = eav if since is None else eav.where(F.col("year") >= since)
    wide = pivot_values(eav, ["year", "region"], "metric", ["value"], metrics)
    rows = cut_lineage(standardize(K.clean_names(wide).dropna(), ["harvest"]))
    out = rows.groupBy("year").agg(F.max("gsi").alias("gsi"))
    for name, fill in (("temp", None), ("harvest", F.lit(0.0)), ("y", None)):
        m = pivot_mean_fill(rows, "year", "region", name, regions, fill)
        out = out.join(m.toDF("year", *[f"{name}_{k}" for k in regions]), "year")
    first = rows.where(F.col("year") == rows.agg(F.min("year").alias("y0")).scalar())
    x0 = first.agg(*[F.max(F.when(F.col("region") == k, F.col("y"))).alias(f"x0_{k}") for k in regions])
    return out.select("*", *[x0.select(f"x0_{k}").scalar().alias(f"x0_{k}") for k in regions])
