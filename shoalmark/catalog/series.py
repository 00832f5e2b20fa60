"""Queries on yearly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .base import query, r, rnd, table
from .summaries import ALL_TEMP_SQL, LANDINGS_SQL, all_temps, landed


@query("autocorrelation", f"""WITH daily AS (
  SELECT o_orderpriority AS g, o_orderdate AS d, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
s AS (SELECT g, x - avg(x) OVER (PARTITION BY g) AS e, row_number() OVER (PARTITION BY g ORDER BY d) AS p,
        count(*) OVER (PARTITION BY g) AS n FROM daily),
v AS (SELECT g, sum(e * e) AS v FROM s GROUP BY g)
SELECT a.g, CAST(l.lag AS INTEGER) AS lag, {r('sum(a.e * b.e) / any_value(v.v)')} AS acf
FROM s a JOIN range(0, 100) l(lag) ON l.lag <= floor(10 * log10(a.n))
JOIN s b ON a.g = b.g AND b.p = a.p + l.lag JOIN v ON v.g = a.g GROUP BY a.g, l.lag""")
def autocorrelation(spark, sf):
    daily = (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderdate").alias("d"))
             .agg(F.avg("o_totalprice").alias("x")))
    return S.autocorrelation(daily, ["g"], ["d"], "x").withColumn("acf", rnd("acf"))


YEARLY_SQL = f"""{LANDINGS_SQL}, yearly AS (
  SELECT id, CASE WHEN year = 1998 AND id < 9 THEN 1997 ELSE year END AS year, avg(landed) / 1e5 AS y FROM landed GROUP BY ALL)"""


def yearly(spark, sf):
    """Mean landings by area and year; some areas reported 1998 with 1997, which leaves a gap."""
    late = (F.col("year") == 1998) & (F.col("id") < 9)
    return (landed(spark, sf).withColumn("year", F.when(late, 1997).otherwise(F.col("year")))
            .groupBy("id", "year").agg((F.avg("landed") / 1e5).alias("y")))


@query("ar1_lag_terms", f"""WITH {YEARLY_SQL}
SELECT id, year, {r('y')} AS y, {r('lag(y) OVER w')} AS prev_y, year - lag(year) OVER w AS gap
FROM yearly WINDOW w AS (PARTITION BY id ORDER BY year)""")
def ar1_lag_terms(spark, sf):
    # the rows are grouped by (id, year), so they are unique by construction
    out = S.previous(yearly(spark, sf), ["id"], "year", ["y"], checked=True)
    return out.select("id", "year", rnd("y").alias("y"), rnd("prev_y").alias("prev_y"), "gap")


@query("ar1_recursion", f"""WITH RECURSIVE {YEARLY_SQL}, s AS (
  SELECT id, year, y, row_number() OVER (PARTITION BY id ORDER BY year) AS p FROM yearly),
x AS (SELECT id, year, p, y AS x FROM s WHERE p = 1
  UNION ALL SELECT s.id, s.year, s.p, 0.5e0 * x.x + s.y FROM x JOIN s ON s.id = x.id AND s.p = x.p + 1)
SELECT id, year, {r('x')} AS x_hat FROM x""")
def ar1_recursion(spark, sf):
    y = yearly(spark, sf)
    first = y.groupBy("id").agg(F.min_by("y", "year").alias("x0"))
    return (S.ar1_recursion(y.join(first, "id"), "id", "year", "y", "x0", 0.5)
            .withColumn("x_hat", rnd("x_hat")))


@query("rolling_trend", f"""WITH {YEARLY_SQL}
SELECT id, year, {r('avg(y) OVER (PARTITION BY id ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS trend FROM yearly""")
def rolling_trend(spark, sf):
    return S.rolling_mean(yearly(spark, sf), ["id"], "year", "y").withColumn("trend", rnd("trend"))


@query("trend_per_group", f"""WITH {ALL_TEMP_SQL}
SELECT id, season, {r('regr_slope(temp, year)', 8)} AS slope, {r('regr_intercept(temp, year)')} AS intercept,
  {r('regr_r2(temp, year)', 8)} AS r2, CAST(regr_count(temp, year) AS BIGINT) AS n FROM temps GROUP BY id, season""")
def trend_per_group(spark, sf):
    out = S.trend_per_group(all_temps(spark, sf), ["id", "season"], "year", "temp")
    return out.select("id", "season", rnd("slope", 8).alias("slope"), rnd("intercept").alias("intercept"),
                      rnd("r2", 8).alias("r2"), "n")


@query("model_compare_aic", """WITH m AS (
  SELECT count(*) AS n, regr_syy(l_extendedprice, l_quantity) AS syy,
    regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss FROM lineitem)
SELECT 'mean only' AS model, round(n * ln(2 * pi() * syy / n) + n + 4 + 1.3e-6, 3) AS aic FROM m
UNION ALL SELECT 'straight line', round(n * ln(2 * pi() * rss / n) + n + 6 + 1.3e-6, 3) FROM m""")
def model_compare_aic(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    m = table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2"))
    rss = F.col("syy") * (1 - F.col("r2"))
    n = F.col("n")
    models = F.array(
        F.struct(F.lit("mean only").alias("model"), S.gaussian_aic(n, F.col("syy"), 1).alias("aic")),
        F.struct(F.lit("straight line").alias("model"), S.gaussian_aic(n, rss, 2).alias("aic")))
    return m.select(F.inline(models)).withColumn("aic", F.round(F.col("aic") + F.lit(1.3e-6), 3))
