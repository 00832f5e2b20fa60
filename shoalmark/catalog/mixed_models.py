"""Queries on mixed models whose estimates have a closed form, because the panels they are fitted to are complete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, field, linear as L, mixed
from .base import query, r, rnd, table

# Mean price per quantity and year: every quantity is sold in every year. Effects of known size make all variances positive.
PANEL_SQL = """bal AS (SELECT station, yr, p / 1e4 + 0.5e0 * (yr % 3) + station % 7 AS y FROM (
  SELECT CAST(l_quantity AS INTEGER) AS station, CAST(year(l_shipdate) AS INTEGER) AS yr, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL))"""

# Two crossed random terms over a complete table of a x b cells: the analysis of variance is the restricted likelihood fit.
CROSSED_SQL = f"""{PANEL_SQL}, g AS (SELECT avg(y) AS m, count(DISTINCT station) AS a, count(DISTINCT yr) AS b, count(*) AS n FROM bal),
s AS (SELECT station, avg(y) AS m FROM bal GROUP BY station), t AS (SELECT yr, avg(y) AS m FROM bal GROUP BY yr),
ms AS (SELECT m AS mu, a, b, n, b * (SELECT sum((s.m - g.m) ** 2) FROM s) / (a - 1) AS msa, a * (SELECT sum((t.m - g.m) ** 2) FROM t) / (b - 1) AS msb,
  (SELECT sum((y - s.m - t.m + g.m) ** 2) FROM bal JOIN s USING (station) JOIN t USING (yr)) / ((a - 1) * (b - 1)) AS mse FROM g),
v AS (SELECT *, (msa - mse) / b AS va, (msb - mse) / a AS vb, msa + msb - mse AS l0 FROM ms),
ua AS (SELECT station, (msa - mse) / msa * (m - mu) AS u FROM s, v), ub AS (SELECT yr, (msb - mse) / msb * (m - mu) AS u FROM t, v)"""


def panel(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(
        F.col("l_quantity").cast("int").alias("station"), F.year("l_shipdate").alias("yr")).agg(F.avg("l_extendedprice").alias("p"))
    return p.select("station", "yr", (F.col("p") / 1e4 + 0.5 * (F.col("yr") % 3) + F.col("station") % 7).alias("y"))


def crossed_fit(df):
    return mixed.fit_mixed(df, "y", [], (mixed.RandomTerm("station"), mixed.RandomTerm("yr")))


@query("lmm_crossed_variances", f"""WITH {CROSSED_SQL}
SELECT 'fixed' AS kind, '(Intercept)' AS term, {r('mu', 4)} AS estimate, {r('sqrt(l0 / n)', 4)} AS std_error FROM v
UNION ALL SELECT 'variance', 'station', {r('va', 4)}, NULL FROM v UNION ALL SELECT 'variance', 'yr', {r('vb', 4)}, NULL FROM v
UNION ALL SELECT 'variance', 'residual', {r('mse', 4)}, NULL FROM v
UNION ALL SELECT 'effect', 'station=' || station, {r('u', 4)}, NULL FROM ua UNION ALL SELECT 'effect', 'yr=' || yr, {r('u', 4)}, NULL FROM ub""")
def lmm_crossed_variances(spark, sf):
    t = crossed_fit(panel(spark, sf)).table(spark)
    return t.select("kind", "term", rnd("estimate", 4).alias("estimate"), rnd("std_error", 4).alias("std_error"))


@query("predict_rows_mixed", f"""WITH {CROSSED_SQL} SELECT station, yr, {r('mu + ua.u + ub.u', 4)} AS estimate, {r('mu', 4)} AS population,
  {r('(y - mu - ua.u - ub.u) / sqrt(mse)', 4)} AS residual FROM bal JOIN ua USING (station) JOIN ub USING (yr), v
UNION ALL SELECT -1, yr, {r('mu + ub.u', 4)}, {r('mu', 4)}, NULL FROM ub, v""")
def predict_rows_mixed(spark, sf):
    """The panel, and a station that the fit has not seen in every year."""
    p = panel(spark, sf)
    new = p.select(F.lit(-1).alias("station"), "yr").distinct().withColumn("y", F.lit(None).cast("double"))
    out = crossed_fit(p).predict(p.unionByName(new), "estimate", "population", "residual")
    return out.select("station", "yr", *[rnd(c, 4).alias(c) for c in ("estimate", "population", "residual")])


_SE = "sqrt(l0 / n + va * (1 - (msa - mse) / msa * (1 - 1e0 / a)) - 2 * va / a)"


@query("marginal_prediction_mixed", f"""WITH {CROSSED_SQL}, p AS (
  SELECT station, mu + u AS est, {_SE} AS se FROM ua, v UNION ALL SELECT -1, mu, sqrt(l0 / n + va) FROM v)
SELECT station, {r('est', 4)} AS estimate, {r('se', 4)} AS std_error, {r('est - 1.96e0 * se', 4)} AS lwr, {r('est + 1.96e0 * se', 4)} AS upr FROM p""")
def marginal_prediction_mixed(spark, sf):
    """Mean of every station over the years, with the error of the station's own effect; -1 is a station never seen."""
    p = panel(spark, sf)
    grid = p.select("station").union(p.select(F.lit(-1).alias("station"))).distinct()
    out = crossed_fit(p).predict_interval(grid, "station")
    return out.select("station", *[rnd(c, 4).alias(c) for c in ("estimate", "std_error", "lwr", "upr")])


@query("model_compare_fits", f"""WITH {CROSSED_SQL}, o AS (SELECT sum((y - (SELECT m FROM g)) ** 2) AS rss0, regr_syy(y, yr) * (1 - regr_r2(y, yr)) AS rss1,
  regr_sxx(y, yr) AS sxx FROM bal),
ll AS (SELECT 'mean only' AS model, n, 2 AS df, -n / 2e0 * (ln(2 * pi() * rss0 / n) + 1) AS ml,
    -((n - 1) * (ln(2 * pi() * rss0 / (n - 1)) + 1) + ln(n)) / 2 AS reml FROM o, v
  UNION ALL SELECT 'line in year', n, 3, -n / 2e0 * (ln(2 * pi() * rss1 / n) + 1), -((n - 2) * (ln(2 * pi() * rss1 / (n - 2)) + 1) + ln(n * sxx)) / 2 FROM o, v
  UNION ALL SELECT 'crossed', n, 4, -(n * ln(2 * pi()) + (a - 1) * ln(msa) + (b - 1) * ln(msb) + (a - 1) * (b - 1) * ln(mse) + ln(l0) + n - 1) / 2,
    -((n - 1) * ln(2 * pi()) + (a - 1) * ln(msa) + (b - 1) * ln(msb) + (a - 1) * (b - 1) * ln(mse) + ln(l0) + ln(n / l0) + n - 1) / 2 FROM v)
SELECT model, CAST(n AS BIGINT) AS n, CAST(df AS INTEGER) AS df, {r('ml', 3)} AS log_lik, {r('reml', 3)} AS log_lik_reml, {r('2 * df - 2 * ml', 3)} AS aic,
  {r('2 * df - 2 * reml', 3)} AS aic_reml, {r('ln(n) * df - 2 * ml', 3)} AS bic, {r('2 * df - 2 * ml - (SELECT min(2 * df - 2 * ml) FROM ll)', 3)} AS delta_aic FROM ll""")
def model_compare_fits(spark, sf):
    p = panel(spark, sf)
    fits = {"mean only": L.fit_ols(p, "y", []), "line in year": L.fit_ols(p, "y", [("yr",)]), "crossed": crossed_fit(p)}
    out = comparison.compare_fits(spark, fits)
    return out.select("model", "n", "df", *[rnd(c, 3).alias(c) for c in ("log_lik", "log_lik_reml", "aic", "aic_reml", "bic", "delta_aic")])


# ---- a field with covariates ------------------------------------------------------------------

# Mean price per cell (ten bands of quantity), year and season: cell-years nested in cells, the season in every one of them.
NESTED_SQL = """obs AS (SELECT cell, yr, season, p / 1e4 + (cell * yr) % 5 + 5 * (cell % 3) AS y FROM (
  SELECT CAST(ceil(l_quantity / 5) AS INTEGER) AS cell, CAST(year(l_shipdate) AS INTEGER) AS yr,
    CASE WHEN dayofyear(l_shipdate) < 183 THEN 'Spring' ELSE 'Fall' END AS season, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL)),
g AS (SELECT avg(y) AS m, count(DISTINCT cell) AS a, count(DISTINCT yr) AS b FROM obs),
se AS (SELECT season, avg(y) AS m FROM obs GROUP BY season),
c AS (SELECT cell, avg(y) AS m FROM obs GROUP BY cell), ct AS (SELECT cell, yr, avg(y) AS m FROM obs GROUP BY cell, yr),
ms AS (SELECT g.m AS mu, a, b, 2 * b * (SELECT sum((c.m - g.m) ** 2) FROM c) / (a - 1) AS msc,
  2 * (SELECT sum((ct.m - c.m) ** 2) FROM ct JOIN c USING (cell)) / (a * (b - 1)) AS mst,
  (SELECT sum((y - ct.m - se.m + g.m) ** 2) FROM obs JOIN ct USING (cell, yr) JOIN se USING (season)) / (a * b - 1) AS mse FROM g),
fit AS (SELECT cell, yr, mu, (msc - mst) / msc * (c.m - mu) AS cell_effect, (mst - mse) / mst * (ct.m - mu - (msc - mst) / msc * (c.m - mu)) AS time_effect,
  msc, mst, mse, a, b FROM ct JOIN c USING (cell), ms)"""


def nested_panel(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(
        F.ceil(F.col("l_quantity") / 5).cast("int").alias("cell"), F.year("l_shipdate").alias("yr"),
        F.when(F.dayofyear("l_shipdate") < 183, "Spring").otherwise("Fall").alias("season")).agg(F.avg("l_extendedprice").alias("p"))
    c = F.col("cell")
    return p.select("cell", "yr", "season", (F.col("p") / 1e4 + (c * F.col("yr")) % 5 + 5 * (c % 3)).alias("y"))


def season_field(spark, sf):
    return field.fit_covariate_field(nested_panel(spark, sf), ["cell"], "yr", "y", [("season",)], {"season": ["Fall", "Spring"]})


@query("field_with_covariates", f"""WITH {NESTED_SQL}, d AS (SELECT (SELECT m FROM se WHERE season = 'Spring') - (SELECT m FROM se WHERE season = 'Fall') AS d)
SELECT 'effect' AS kind, cell, yr, {r('cell_effect', 4)} AS cell_effect, {r('time_effect', 4)} AS time_effect, NULL AS term, CAST(NULL AS DOUBLE) AS estimate FROM fit
UNION ALL SELECT 'fixed', NULL, NULL, NULL, NULL, 'season[Spring]', {r('d', 4)} FROM d UNION ALL SELECT 'fixed', NULL, NULL, NULL, NULL, '(Intercept)', {r('mu - d / 2', 4)} FROM ms, d
UNION ALL SELECT 'variance', NULL, NULL, NULL, NULL, 'cell', {r('(msc - mst) / (2 * b)', 4)} FROM ms
UNION ALL SELECT 'variance', NULL, NULL, NULL, NULL, 'cell by time', {r('(mst - mse) / 2', 4)} FROM ms UNION ALL SELECT 'variance', NULL, NULL, NULL, NULL, 'residual', {r('mse', 4)} FROM ms""")
def field_with_covariates(spark, sf):
    fit = season_field(spark, sf)
    cells = fit.effects().select(F.lit("effect").alias("kind"), "cell", "yr", rnd("cell_effect", 4).alias("cell_effect"), rnd("time_effect", 4).alias("time_effect"))
    rest = fit.estimates(spark).select("kind", "term", rnd("estimate", 4).alias("estimate"))
    return cells.unionByName(rest, allowMissingColumns=True)


@query("predict_grid_covariates", f"""WITH {NESTED_SQL}, years AS (SELECT yr FROM (SELECT DISTINCT yr FROM obs) UNION ALL SELECT 2050),
cells AS (SELECT DISTINCT cell FROM obs UNION ALL SELECT 99)
SELECT cell, yr, season, {r('m + coalesce((SELECT max(cell_effect) FROM fit WHERE fit.cell = cells.cell), 0) + coalesce((SELECT max(time_effect) FROM fit WHERE fit.cell = cells.cell AND fit.yr = years.yr), 0)', 4)} AS est
FROM cells, years, se""")
def predict_grid_covariates(spark, sf):
    """Every cell, year and season, with a cell and a year that the fit has not seen."""
    from ..operators.reshape import replicate
    p = nested_panel(spark, sf)
    one = p.select("cell").union(p.select(F.lit(99))).distinct()
    years = p.select("yr").union(p.select(F.lit(2050))).distinct()
    grid = replicate(replicate(one, years), p.select("season").distinct())
    return season_field(spark, sf).predict(grid).select("cell", "yr", "season", rnd("est", 4).alias("est"))
