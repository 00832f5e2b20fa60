"""Queries on community-weighted means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as C
from .base import CATCH_SQL, TOWS_SQL, TRAITS_SQL, query, r, rnd, survey_catch, traits

SITE = ["tow", "est_year", "season"]
TRAITS = ["trait_size", "trait_price"]

CWM_SQL = f"""cwm AS (
  SELECT tow, est_year, season,
         sum(biomass_kg * trait_size) / nullif(sum(biomass_kg), 0e0) AS trait_size,
         sum(biomass_kg * trait_price) / nullif(sum(biomass_kg), 0e0) AS trait_price
  FROM tows JOIN traits USING (svspp)
  WHERE trait_size IS NOT NULL AND trait_price IS NOT NULL
  GROUP BY ALL)"""


def tow_cwm(spark, sf, na_policy="drop_species"):
    return C.cwm(C.tow_totals(survey_catch(spark, sf)), traits(spark, sf), SITE, "svspp",
                 "biomass_kg", TRAITS, na_policy)


@query("cwm", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}
SELECT tow, est_year, season, {r('trait_size')} AS trait_size, {r('trait_price')} AS trait_price
FROM cwm""")
def cwm(spark, sf):
    return tow_cwm(spark, sf).select(*SITE, *[rnd(c).alias(c) for c in TRAITS])


@query("cwm_crosscheck", f"""WITH {TOWS_SQL}, {TRAITS_SQL}
SELECT count(*) AS n_sites, 0e0 AS max_abs_diff FROM (
  SELECT DISTINCT tow, est_year, season FROM tows JOIN traits USING (svspp)
  WHERE trait_size IS NOT NULL)""")
def cwm_crosscheck(spark, sf):
    a = tow_cwm(spark, sf)
    b = C.cwm_by_proportion(C.tow_totals(survey_catch(spark, sf)), traits(spark, sf), SITE,
                            "svspp", "biomass_kg", TRAITS)
    both = a.alias("a").join(b.alias("b"), SITE)
    diff = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in TRAITS])
    return both.agg(F.count("*").alias("n_sites"), rnd(F.max(diff)).alias("max_abs_diff"))


@query("row_total", f"""WITH {TOWS_SQL}
SELECT tow, est_year, season, {r('sum(biomass_kg)')} AS total FROM tows GROUP BY ALL""")
def row_total(spark, sf):
    return (C.row_total(C.tow_totals(survey_catch(spark, sf)), SITE, "biomass_kg")
            .select(*SITE, rnd("total").alias("total")))


@query("distinct_rows", f"""WITH {CATCH_SQL}
SELECT DISTINCT svspp, catchsex, abundance, biomass_kg, tow, est_year, season FROM catch""")
def distinct_rows(spark, sf):
    return survey_catch(spark, sf).drop("length_cm").distinct()


@query("group_all_except_sum", f"""WITH {CATCH_SQL}, nulled AS (
  SELECT DISTINCT svspp, catchsex, abundance, nullif(biomass_kg, 13e0) AS biomass_kg,
         tow, est_year, season FROM catch)
SELECT svspp, tow, est_year, season, {r('sum(abundance)', 4)} AS abundance,
       CASE WHEN count(*) = count(biomass_kg) THEN sum(biomass_kg) END AS biomass_kg
FROM nulled GROUP BY svspp, tow, est_year, season""")
def group_all_except_sum(spark, sf):
    catch = survey_catch(spark, sf).withColumn(
        "biomass_kg", F.nullif(F.col("biomass_kg"), F.lit(13.0)))
    return C.tow_totals(catch).withColumn("abundance", rnd("abundance", 4))
