"""Area and tow series: trait means, temperature, landings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as K
from ..functions.nulls import drop_na_all, ln0, ratio, sum0
from ..operators.community import cwm, tow_totals
from ..operators.joins import enrich_back
from ..operators.reshape import complete_grid, pivot_longer
from ..operators.spatial import add_utm, point_in_polygon
from ..session import cut_lineage


def tow_areas(tows: DataFrame, edges: DataFrame, tow: str, lon: str, lat: str) -> DataFrame:
    """Area of every tow position; the positions, not the catch rows, are placed."""
    return point_in_polygon(tows.select(tow, lon, lat), edges, lon, lat).select(tow, "area")


def cwm_by_area(catch: DataFrame, tows: DataFrame, edges: DataFrame, traits: DataFrame, trait_cols: Sequence[str],
                tow: str = "tow", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Trait means per year, season and area; tows outside every area form a group of their own.

    Biomass is summed per tow and species before the area is attached, and per area and species
    before the traits are.
    """
    totals = tow_totals(catch)
    placed = totals.join(tow_areas(tows, edges, tow, lon, lat), tow, "left")
    by_area = placed.groupBy("est_year", "season", "area", "svspp").agg(sum0("biomass_kg").alias("biomass_kg"))
    return cwm(by_area, traits, ["est_year", "season", "area"], "svspp", "biomass_kg", trait_cols)


def cwm_by_tow(catch: DataFrame, meta: DataFrame, attrs: Sequence[str], traits: DataFrame,
               trait_cols: Sequence[str], tow: str = "tow") -> DataFrame:
    """Trait means per tow with the tow attributes re-attached."""
    means = cwm(tow_totals(catch), traits, [tow, "est_year", "season"], "svspp", "biomass_kg", trait_cols)
    return enrich_back(means, meta, [tow], attrs)


def bottom_temp_by_area(grid: DataFrame, stations: DataFrame, edges: DataFrame, key: str, lon: str = "lon",
                        lat: str = "lat", value: str = "temp") -> DataFrame:
    """Seasonal mean and sd of a long temperature grid per year and area.

    ``grid(key, year, day, value)`` refers to ``stations(key, lon, lat)``; readings outside the
    survey days are filtered at the scan, stations outside every area are dropped.
    """
    area = (point_in_polygon(stations, edges, lon, lat, how="inner").select(key, "area"))
    rows = grid.where(K.survey_days("day")).join(area, key)
    return (rows.groupBy("year", K.season_from_day("day").alias("season"), "area")
            .agg(F.avg(value).alias("mean_temp"), F.stddev_samp(value).alias("sd_temp")))


def area_model_table(means: DataFrame, temps: DataFrame, landings: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row per (year, id, season, axis) with its covariates.

    ``means(year, id, season, axes...)``, ``temps(year, id, season, mean_temp, sd_temp)`` and
    ``landings(year, id, landings)``. ``cv_temp`` is mean over sd, as the analysis defines it; ``time`` is the year as a number,
    ``year_fct`` and ``stat_area`` are the year and the area as factors.
    """
    # a small table at the end of two full passes, read again for its levels
    wide = cut_lineage(means.join(temps, ["year", "id", "season"], "left"))
    # completed with the rows outside every area, which may be all that a year has; they go afterwards
    full = complete_grid(wide, ["year", "id", "season"]).join(landings, ["year", "id"], "left").where("id IS NOT NULL")
    full = full.withColumn("cv_temp", ratio("mean_temp", "sd_temp"))
    measures = [*axes, "mean_temp", "sd_temp", "landings", "cv_temp"]
    kept = drop_na_all(full, *measures)
    ids = [c for c in kept.columns if c not in axes]
    long = pivot_longer(kept, ids, axes, "pca_axis", "pca_value")
    return long.withColumns({"log_landings": ln0("landings"), "time": F.col("year").cast("double"),
                             "year_fct": F.col("year").cast("string"), "stat_area": F.col("id").cast("string")})


def covariate_tows(means: DataFrame, stations: DataFrame, covariates: DataFrame, zone: int = 19) -> DataFrame:
    """Tow means joined to covariates by composite id, dropped without a position, projected.

    ``stations(tow, cruise, station, stratum)`` holds the parts of the id.
    """
    ids = stations.select("tow", K.composite_id("cruise", "station", "stratum").alias("id"))
    rows = means.join(ids, "tow").withColumn("season", F.upper("season"))
    rows = rows.join(covariates, "id", "left").dropna(how="any", subset=["lon", "lat"])
    return add_utm(rows, "lon", "lat", zone)
