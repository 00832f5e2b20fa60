"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import _c

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footer once and declared afterwards."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _off_tie(digits: int) -> float:
    """A nudge far below the kept digits: averages of short decimals often end on an exact tie,
    which summation order would otherwise decide."""
    return float(f"1.3e-{digits + 3}")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded value, never negative zero, so both engines agree on it."""
    return F.round(_c(c).cast("double") + F.lit(_off_tie(digits)), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """SQL text of :func:`rnd`."""
    return f"(round(CAST({expr} AS DOUBLE) + {_off_tie(digits):e}, {digits}) + 0e0)"


# ---- the survey tables as views of the given tables ------------------------------------------
# One lineitem row stands for one measured fish: part = species, supplier = tow position,
# ship date = sampling date, return flag = sex class, line number = fish length.

def survey_catch(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofyear("l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("svspp"),
        F.col("l_returnflag").alias("catchsex"),
        F.col("l_extendedprice").alias("abundance"),
        F.col("l_quantity").alias("biomass_kg"),
        F.col("l_suppkey").alias("tow"),
        F.year("l_shipdate").alias("est_year"),
        F.when(day < 183, "Spring").otherwise("Fall").alias("season"),
        F.col("l_linenumber").alias("length_cm"),
    )


CATCH_SQL = """catch AS (
  SELECT l_partkey AS svspp, l_returnflag AS catchsex, l_extendedprice AS abundance,
         l_quantity AS biomass_kg, l_suppkey AS tow, CAST(year(l_shipdate) AS INTEGER) AS est_year,
         CASE WHEN dayofyear(l_shipdate) < 183 THEN 'Spring' ELSE 'Fall' END AS season,
         l_linenumber AS length_cm
  FROM lineitem)"""

# Per-catch rows and tow totals, as SQL.
TOWS_SQL = CATCH_SQL + """, per_catch AS (
  SELECT DISTINCT svspp, catchsex, abundance, biomass_kg, tow, est_year, season FROM catch),
tows AS (
  SELECT svspp, tow, est_year, season,
         CASE WHEN count(*) = count(abundance) THEN sum(abundance) END AS abundance,
         CASE WHEN count(*) = count(biomass_kg) THEN sum(biomass_kg) END AS biomass_kg
  FROM per_catch GROUP BY ALL)"""


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """Species traits; a size of 7 counts as unmeasured."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("svspp"),
        F.nullif(F.col("p_size"), F.lit(7)).cast("double").alias("trait_size"),
        F.col("p_retailprice").alias("trait_price"),
    )


TRAITS_SQL = """traits AS (
  SELECT p_partkey AS svspp, CAST(nullif(p_size, 7) AS DOUBLE) AS trait_size,
         p_retailprice AS trait_price FROM part)"""
