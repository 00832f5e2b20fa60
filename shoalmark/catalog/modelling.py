"""Queries on fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K, nulls as N
from ..operators import ar1, field, linear as L, mixed, ordering as O, pca, reshape as R, series as S, spatial as G, state_space as SS
from .base import TOWS_SQL, TRAITS_SQL, query, r, rnd, table
from .community import CWM_SQL, tow_cwm
from .series import YEARLY_SQL, yearly
from .spatial import GRID_SQL, TOWXY_SQL, tow_estimates, utm_positions

# ---- components -----------------------------------------------------------------------------

PCA_SQL = """tm AS (SELECT p_partkey AS svspp, ln(p_retailprice) AS a, ln(avg(l_quantity)) AS b
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_retailprice),
st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, corr(a, b) AS rho FROM tm)"""


def trait_means(spark, sf):
    """Log mean traits per species."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("svspp")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
        F.avg("l_tax").alias("tax"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("svspp"), F.col("p_retailprice").alias("retail"), F.col("p_size").cast("double").alias("size"))
    t = p.join(li, "svspp")
    return K.across(t, K.columns_of_type(t), N.ln0)


@query("pca_scores", f"""WITH {PCA_SQL}, z AS (SELECT svspp, (a - ma) / sa AS za, (b - mb) / sb AS zb, rho FROM tm, st)
SELECT svspp, {r('(za + sign(rho) * zb) / sqrt(2e0)')} AS "PC1", {r('(za - sign(rho) * zb) / sqrt(2e0)')} AS "PC2" FROM z""")
def pca_scores(spark, sf):
    t = trait_means(spark, sf).select("svspp", "retail", "quantity")
    fit = pca.fit_pca(t, ["retail", "quantity"], 2)
    return fit.scores(t, ["svspp"]).select("svspp", rnd("PC1").alias("PC1"), rnd("PC2").alias("PC2"))


# ---- linear models --------------------------------------------------------------------------

ROWS_SQL = """obs AS (SELECT l_orderkey, CAST(year(l_shipdate) AS INTEGER) AS est_year, n_regionkey AS survey_area,
  CASE WHEN dayofyear(l_shipdate) < 183 THEN 'Spring' ELSE 'Fall' END AS season, l_quantity AS bottemp, 100 * l_discount AS y,
  n_nationkey AS stat_area, l_linenumber AS svvessel
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def observations(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", F.year("l_shipdate").alias("est_year"),
        F.when(F.dayofyear("l_shipdate") < 183, "Spring").otherwise("Fall").alias("season"),
        F.col("l_quantity").alias("bottemp"), (100 * F.col("l_discount")).alias("y"),
        F.col("l_linenumber").alias("svvessel"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("stat_area"), F.col("n_regionkey").alias("survey_area"))
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.stat_area)
            .drop("l_suppkey", "s_suppkey", "s_nationkey"))


FULL = L.crossed("est_year", "survey_area", "season")

# A common slope for bottemp and one line in year per (area, season): sums of squares within cells.
_CELLS_SQL = f"""{ROWS_SQL}, c AS (SELECT survey_area AS a, season AS s, count(*) AS n, avg(est_year) AS tm, avg(bottemp) AS bm, avg(y) AS ym,
    regr_sxx(y, est_year) AS stt, covar_pop(y, est_year) * count(*) AS sty, covar_pop(bottemp, est_year) * count(*) AS sbt,
    var_pop(bottemp) * count(*) AS sbb, covar_pop(y, bottemp) * count(*) AS sby, var_pop(y) * count(*) AS syy FROM obs GROUP BY ALL),
b AS (SELECT sum(sby - sbt * sty / stt) / sum(sbb - sbt * sbt / stt) AS b FROM c),
cell AS (SELECT a, s, (sty - b * sbt) / stt AS slope, ym - (sty - b * sbt) / stt * tm - b * bm AS icept FROM c, b)"""


@query("ols_interaction", f"""WITH {_CELLS_SQL}, g AS (SELECT k.a, k.s, k.slope, k.icept, ra.slope AS a_slope, ra.icept AS a_icept,
    rs.slope AS s_slope, rs.icept AS s_icept, rr.slope AS r_slope, rr.icept AS r_icept
  FROM cell k JOIN cell ra ON ra.a = k.a AND ra.s = 'Fall' JOIN cell rs ON rs.a = 0 AND rs.s = k.s
  JOIN cell rr ON rr.a = 0 AND rr.s = 'Fall')
SELECT term, {r('estimate')} AS estimate FROM (
  SELECT '(Intercept)' AS term, icept AS estimate FROM g WHERE a = 0 AND s = 'Fall'
  UNION ALL SELECT 'est_year', slope FROM g WHERE a = 0 AND s = 'Fall'
  UNION ALL SELECT 'bottemp', b FROM b
  UNION ALL SELECT 'survey_area[' || a || ']', icept - r_icept FROM g WHERE a > 0 AND s = 'Fall'
  UNION ALL SELECT 'est_year:survey_area[' || a || ']', slope - r_slope FROM g WHERE a > 0 AND s = 'Fall'
  UNION ALL SELECT 'season[Spring]', icept - r_icept FROM g WHERE a = 0 AND s = 'Spring'
  UNION ALL SELECT 'est_year:season[Spring]', slope - r_slope FROM g WHERE a = 0 AND s = 'Spring'
  UNION ALL SELECT 'survey_area[' || a || ']:season[Spring]', icept - a_icept - s_icept + r_icept FROM g WHERE a > 0 AND s = 'Spring'
  UNION ALL SELECT 'est_year:survey_area[' || a || ']:season[Spring]', slope - a_slope - s_slope + r_slope FROM g WHERE a > 0 AND s = 'Spring')""")
def ols_interaction(spark, sf):
    fit = L.fit_ols(observations(spark, sf), "y", FULL + [("bottemp",)], ["survey_area", "season"])
    return fit.coefficients(spark).select("term", rnd("estimate").alias("estimate"))


LINE_SQL = """m AS (SELECT count(*) AS n, avg(l_quantity) AS xm, avg(l_extendedprice) AS ym, regr_sxx(l_extendedprice, l_quantity) AS sxx,
  regr_slope(l_extendedprice, l_quantity) AS b, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss FROM lineitem),
co AS (SELECT 'l_quantity' AS term, b AS estimate, sqrt(rss / (n - 2) / sxx) AS se FROM m
  UNION ALL SELECT '(Intercept)', ym - b * xm, sqrt(rss / (n - 2) * (1e0 / n + xm * xm / sxx)) FROM m)"""


@query("tidy_coefficients", f"""WITH {LINE_SQL} SELECT term, {r('estimate', 4)} AS estimate, {r('se', 4)} AS std_error,
  {r('estimate - 1.96e0 * se', 4)} AS lwr, {r('estimate + 1.96e0 * se', 4)} AS upr FROM co""")
def tidy_coefficients(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    t = L.fit_ols(df, "l_extendedprice", [("l_quantity",)]).coefficients(spark)
    return t.select("term", *[rnd(c, 4).alias(c) for c in ("estimate", "std_error", "lwr", "upr")])


_LINES_SQL = f"""{ROWS_SQL}, c AS (SELECT survey_area, season, count(*) AS n, avg(est_year) AS tm, regr_sxx(y, est_year) AS sxx,
  regr_slope(y, est_year) AS b, regr_intercept(y, est_year) AS a, regr_syy(y, est_year) * (1 - regr_r2(y, est_year)) AS rss FROM obs GROUP BY ALL),
s AS (SELECT sum(rss) / (sum(n) - 2 * count(*)) AS s2 FROM c)"""


@query("predict_rows", f"""WITH {_LINES_SQL} SELECT l_orderkey, est_year, survey_area, season, bottemp, {r('a + b * est_year')} AS estimate,
  {r('(y - a - b * est_year) / sqrt(s2)')} AS residual FROM obs JOIN c USING (survey_area, season), s""")
def predict_rows(spark, sf):
    obs = observations(spark, sf)
    fit = L.fit_ols(obs, "y", FULL, ["survey_area", "season"])
    out = fit.predict(obs, "estimate", "residual")
    return out.select("l_orderkey", "est_year", "survey_area", "season", "bottemp",
                      rnd("estimate").alias("estimate"), rnd("residual").alias("residual"))


@query("marginal_prediction", f"""WITH {_LINES_SQL}, g AS (SELECT CAST(i AS INTEGER) AS step, lo + (hi - lo) * i / 99e0 AS t
  FROM (SELECT min(est_year) AS lo, max(est_year) AS hi FROM obs), range(0, 100) x(i)),
p AS (SELECT step, survey_area, season, a + b * t AS est, sqrt(s2 * (1e0 / n + (t - tm) * (t - tm) / sxx)) AS se FROM g, c, s)
SELECT step, survey_area, season, {r('est')} AS estimate, {r('se')} AS std_error, {r('est - 1.96e0 * se')} AS lwr, {r('est + 1.96e0 * se')} AS upr FROM p""")
def marginal_prediction(spark, sf):
    obs = observations(spark, sf)
    fit = L.fit_ols(obs, "y", FULL, ["survey_area", "season"])
    cells = obs.select("survey_area", "season").distinct()
    grid = R.replicate(cells, L.value_grid(obs, "est_year"))
    out = fit.predict_interval(grid)
    return out.select("step", "survey_area", "season", *[rnd(c).alias(c) for c in ("estimate", "std_error", "lwr", "upr")])


# ---- autocorrelated errors ------------------------------------------------------------------

def tow_series(spark, sf):
    """Tow means as yearly series per (tow, season), with the region of the tow."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tow"), "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("survey_area"))
    return (tow_cwm(spark, sf).join(s, "tow").join(n, F.col("s_nationkey") == n.n_nationkey)
            .select("tow", "season", "est_year", "survey_area", F.col("trait_size").alias("y")))


@query("gls_ar1")
def gls_ar1(spark, sf):
    # one row per (tow, season, year) by construction
    fit = ar1.fit_gls_ar1(tow_series(spark, sf), "y", FULL, ["survey_area", "season"],
                          ["tow", "season"], "est_year", checked=True)
    extra = spark.createDataFrame(
        [("phi", fit.extra["phi"]), ("sigma2", fit.sigma2), ("aic", fit.extra["aic"])], "term string, estimate double")
    return fit.coefficients(spark).select("term", "estimate", "std_error").unionByName(extra, allowMissingColumns=True)


@query("gls_ar1_suffstats", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}, t AS (
  SELECT tow, season, est_year, n_regionkey AS survey_area, trait_size AS y FROM cwm
  JOIN supplier ON tow = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT *, lag(y) OVER w AS py, coalesce(est_year - lag(est_year) OVER w, 0) AS gap FROM t WINDOW w AS (PARTITION BY tow, season ORDER BY est_year))
SELECT survey_area, season, gap, count(*) AS n, {r('avg(y)')} AS m_y, {r('avg(coalesce(py, 0))')} AS m_prev_y, {r('var_pop(y)')} AS c_y_y,
  {r('covar_pop(y, coalesce(py, 0))')} AS c_y_prev_y, {r('covar_pop(est_year, y)')} AS c_est_year_y FROM l GROUP BY ALL""")
def gls_ar1_suffstats(spark, sf):
    m = ar1.ar1_moments(tow_series(spark, sf), "y", ["est_year"], ["survey_area", "season"],
                        ["tow", "season"], "est_year", checked=True)
    return m.select("survey_area", "season", "gap", "n",
                    *[rnd(c).alias(c) for c in ("m_y", "m_prev_y", "c_y_y", "c_y_prev_y", "c_est_year_y")])


# At the estimates, the residuals with their correlation taken out are orthogonal to every column treated alike.
@query("gls_ar1_equations", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}, a AS (SELECT DISTINCT n_regionkey AS a FROM cwm
  JOIN supplier ON tow = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE trait_size IS NOT NULL),
f AS (SELECT '' AS part UNION ALL SELECT 'survey_area[' || a || ']' FROM a WHERE a > (SELECT min(a) FROM a)),
s AS (SELECT '' AS season UNION ALL SELECT 'season[Spring]'), t AS (SELECT '' AS year UNION ALL SELECT 'est_year')
SELECT coalesce(nullif(concat_ws(':', nullif(year, ''), nullif(part, ''), nullif(season, '')), ''), '(Intercept)') AS term, 0e0 AS score FROM f, s, t""")
def gls_ar1_equations(spark, sf):
    rows = tow_series(spark, sf).dropna()
    fit = ar1.fit_gls_ar1(rows, "y", FULL, ["survey_area", "season"], ["tow", "season"], "est_year", checked=True)
    names = [f"_x{i}" for i in range(len(fit.columns))]
    known = rows.withColumns({"_e": F.col("y") - fit.fitted(), **{n: c.expr(fit.centers) for n, c in zip(names, fit.columns)}})
    met = S.previous(known, ["tow", "season"], "est_year", ["_e", *names], checked=True)
    rho = F.when(F.col("gap").isNull(), 0.0).otherwise(F.pow(F.lit(fit.extra["phi"]), F.col("gap")))
    met = met.withColumn("_rho", rho)
    white = lambda c: (F.col(c) - F.col("_rho") * F.coalesce(f"prev_{c}", F.lit(0.0))) / F.sqrt(1 - F.col("_rho") * F.col("_rho"))
    e = white("_e")
    sums = met.agg(*[(F.sum(white(n) * e) / F.sqrt(F.sum(white(n) * white(n)) * F.sum(e * e))).alias(n) for n in names])
    per = F.array(*[F.struct(F.lit(c.name).alias("term"), F.col(n).alias("score")) for n, c in zip(names, fit.columns)])
    return sums.select(F.inline(per)).withColumn("score", rnd("score"))


# ---- mixed models ---------------------------------------------------------------------------

MIXED_FIXED = [("year_c",), ("survey_area",), ("year_c", "survey_area"), ("season",), ("temp_c",)]
MIXED_LEVELS = {"survey_area": [0, 1, 2, 3, 4], "season": ["Fall", "Spring"]}
MIXED_RANDOM = (mixed.RandomTerm("est_year"), mixed.RandomTerm("svvessel"))


def centered(spark, sf):
    """Observations with year and temperature moved near zero."""
    return observations(spark, sf).withColumns(
        {"year_c": F.col("est_year") - 1998, "temp_c": (F.col("bottemp") - 25) / 10})


@query("lmm_random_effects")
def lmm_random_effects(spark, sf):
    return mixed.fit_mixed(centered(spark, sf), "y", MIXED_FIXED, MIXED_RANDOM, MIXED_LEVELS).table(spark)


@query("lmm_random_slopes")
def lmm_random_slopes(spark, sf):
    """Correlated random slopes per statistical area beside a random year."""
    random = (mixed.RandomTerm("est_year"), mixed.RandomTerm("stat_area", ("temp_c", "year_c")))
    return mixed.fit_mixed(centered(spark, sf), "y", [("temp_c",), ("year_c",), ("season",)],
                           random, {"season": ["Fall", "Spring"]}).table(spark)


@query("lmm_suffstats", f"""WITH {ROWS_SQL}, o AS (SELECT *, row_number() OVER () AS id, est_year - 1998 AS year_c, (bottemp - 25) / 10 AS temp_c FROM obs),
d AS (SELECT id, 'fixed (Intercept)' AS nm, 1e0 AS v FROM o UNION ALL SELECT id, 'fixed temp_c', temp_c FROM o
  UNION ALL SELECT id, 'fixed season[Spring]', 1e0 FROM o WHERE season = 'Spring'
  UNION ALL SELECT id, 'stat_area=' || stat_area, 1e0 FROM o UNION ALL SELECT id, 'stat_area:temp_c=' || stat_area, temp_c FROM o
  UNION ALL SELECT id, 'est_year=' || est_year, 1e0 FROM o UNION ALL SELECT id, 'response', y FROM o)
SELECT a.nm AS i, b.nm AS j, {r('sum(a.v * b.v)', 3)} AS v FROM d a JOIN d b ON a.id = b.id AND a.nm <= b.nm GROUP BY a.nm, b.nm""")
def lmm_suffstats(spark, sf):
    cols = L.design([("temp_c",), ("season",)], {"season": ["Fall", "Spring"]})
    out = mixed.cross_products(centered(spark, sf), "y", cols,
                               [mixed.RandomTerm("stat_area", ("temp_c",)), mixed.RandomTerm("est_year")])
    return out.withColumn("v", rnd("v", 3))


# ---- spatial effects ------------------------------------------------------------------------

def _components_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT s1 / n_ AS mu, ssw / nullif(n_ - c_, 0) AS mse,
  greatest(((s2 - s1 * s1 / n_) / nullif(c_ - 1, 0) - ssw / nullif(n_ - c_, 0)) / nullif((n_ - n2 / n_) / nullif(c_ - 1, 0), 0), 0e0) AS bet
  FROM (SELECT CAST(sum(n) AS DOUBLE) AS n_, count(*) AS c_, CAST(sum(n * n) AS DOUBLE) AS n2, sum(ss) AS ssw, sum(n * mean) AS s1, sum(n * mean * mean) AS s2 FROM {src}))"""


FIELD_SQL = f"""{TOWXY_SQL}, meshed AS (SELECT *, CAST(floor(x / 30) AS BIGINT) AS mx, CAST(floor(y / 30) AS BIGINT) AS my FROM est),
fine AS (SELECT mx, my, est_year, count(est) AS n, avg(est) AS mean, var_pop(est) * count(est) AS ss FROM meshed GROUP BY ALL),
cells AS (SELECT mx, my, sum(n) AS n, sum(n * mean) / sum(n) AS mean, sum(ss) + sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n) AS ss FROM fine GROUP BY ALL),
{_components_sql('cells', 'k1')},
ce AS (SELECT mx, my, n * (bet / mse) / (1 + n * (bet / mse)) * (mean - mu) AS cell_effect FROM cells, k1),
rest AS (SELECT f.mx, f.my, est_year, n, ss, mean - mu - cell_effect AS mean, mu, cell_effect FROM fine f JOIN ce USING (mx, my), k1),
{_components_sql('rest', 'k2')},
field AS (SELECT mx, my, est_year, rest.mu, cell_effect, n * (bet / mse) / (1 + n * (bet / mse)) * mean AS time_effect FROM rest, k2)"""


def fitted_field(spark, sf):
    return field.cell_field(G.mesh_cell(tow_estimates(spark, sf)), ["mx", "my"], "est_year", "est")


@query("cell_random_effect_field", f"""WITH {FIELD_SQL} SELECT mx, my, est_year, {r('mu')} AS mu, {r('cell_effect')} AS cell_effect,
  {r('time_effect')} AS time_effect, {r('mu + cell_effect + time_effect')} AS est FROM field""")
def cell_random_effect_field(spark, sf):
    f = fitted_field(spark, sf)
    return f.select("mx", "my", "est_year", *[rnd(c).alias(c) for c in ("mu", "cell_effect", "time_effect", "est")])


def field_on_grid(spark, sf):
    """Field predictions on the survey grid for every year."""
    fit = fitted_field(spark, sf)
    years = fit.select("est_year").distinct()
    grid = R.replicate(G.mesh_cell(G.grid_near_points(utm_positions(spark, sf))), years)
    return field.predict_field(grid, fit, ["mx", "my"], "est_year")


GRIDFIELD_SQL = f"""{FIELD_SQL}, {GRID_SQL[len(GRID_SQL.split(', ext AS')[0]) + 2:]},
near AS (SELECT gx, gy, cx, cy, CAST(floor(cx / 30) AS BIGINT) AS mx, CAST(floor(cy / 30) AS BIGINT) AS my FROM grid
  WHERE EXISTS (SELECT 1 FROM utm WHERE (cx - x) * (cx - x) + (cy - y) * (cy - y) <= 100)),
onto AS (SELECT gx, gy, cx, cy, yr.est_year, (SELECT max(mu) FROM field) + coalesce(ce.cell_effect, 0) + coalesce(f.time_effect, 0) AS est
  FROM near CROSS JOIN (SELECT DISTINCT est_year FROM field) yr LEFT JOIN ce USING (mx, my)
  LEFT JOIN field f ON f.mx = near.mx AND f.my = near.my AND f.est_year = yr.est_year)"""


@query("predict_on_grid", f"WITH {GRIDFIELD_SQL} SELECT gx, gy, est_year, {r('est')} AS est FROM onto")
def predict_on_grid(spark, sf):
    return field_on_grid(spark, sf).select("gx", "gy", "est_year", rnd("est").alias("est"))


# ---- state space ----------------------------------------------------------------------------

PARAMS = {"alpha_0": 0.4, "beta_climate": 0.1, "beta_harvest": -0.2, "beta_temp": 0.3}

PANEL_SQL = f"""{YEARLY_SQL}, panel AS (SELECT id AS region, year, y, (year - 1998) / 3e0 AS climate,
  (y - (SELECT avg(y) FROM yearly)) / (SELECT stddev_samp(y) FROM yearly) AS harvest, y / 10 AS temp FROM yearly),
gam AS (SELECT region, avg(y) - (SELECT avg(y) FROM panel) AS gamma FROM panel GROUP BY region),
mu AS (SELECT p.*, 0.4e0 + 0.1e0 * climate AS mu_pop, 0.4e0 + 0.1e0 * climate + gamma - 0.2e0 * harvest + 0.3e0 * temp AS mu_r FROM panel p JOIN gam USING (region))"""


def panel(spark, sf):
    from ..operators.aggregates import standardize
    y = yearly(spark, sf).withColumnRenamed("id", "region")
    p = standardize(y.withColumn("harvest", F.col("y")), ["harvest"])
    return p.withColumns({"climate": (F.col("year") - 1998) / 3.0, "temp": F.col("y") / 10})


def state_mean(spark, sf):
    p = panel(spark, sf)
    gamma = p.groupBy("region").agg((F.avg("y") - p.agg(F.avg("y").alias("m")).scalar()).alias("gamma"))
    return SS.state_space_mean(p, gamma, PARAMS, climate="climate")


@query("state_space_mean", f"WITH {PANEL_SQL} SELECT region, year, {r('mu_pop')} AS mu_pop, {r('mu_r')} AS mu_r FROM mu")
def state_space_mean(spark, sf):
    return state_mean(spark, sf).select("region", "year", rnd("mu_pop").alias("mu_pop"), rnd("mu_r").alias("mu_r"))


@query("normal_logpdf", f"""WITH {PANEL_SQL} SELECT region, year, {r('-0.5 * ln(2 * pi()) - ln(0.3e0) - (y - mu_r) * (y - mu_r) / (2 * 0.3e0 * 0.3e0)')} AS log_lik FROM mu""")
def normal_logpdf(spark, sf):
    return SS.log_likelihood(state_mean(spark, sf), "y", "mu_r", 0.3).select("region", "year", rnd("log_lik").alias("log_lik"))


@query("draws_recover_types", """WITH lv AS (SELECT n_name AS spectra_area, row_number() OVER (ORDER BY n_name) AS code FROM nation)
SELECT o_orderkey AS draw, o_orderstatus AS param, spectra_area, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN lv ON code = c_nationkey + 1""")
def draws_recover_types(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    draws = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("draw"), F.col("o_orderstatus").alias("param"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("index"), F.col("o_totalprice").alias("value"))
    levels = O.factor_levels(table(spark, sf, "nation").select(F.col("n_name").alias("spectra_area")), "spectra_area", 1)
    return SS.recover_labels(draws, levels, "index", "spectra_area_code", "spectra_area").drop("index")
