"""Queries on aggregates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K, nulls as N
from ..operators import aggregates as A, quantiles as Q, reshape as R
from .base import TOWS_SQL, TRAITS_SQL, query, r, rnd, survey_catch, table
from .community import CWM_SQL, TRAITS, tow_cwm

LANDINGS_SQL = """landed AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS id,
         CASE WHEN o_totalprice >= 20000 THEN o_totalprice END AS landed
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def landed(spark, sf):
    """Landings: orders by year and nation; totals below 20000 count as unreported."""
    o = table(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"),
        F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")).alias("landed"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    return o.join(c, o.o_custkey == c.c_custkey).select("year", "id", "landed")


@query("sum_na_rm", f"""WITH {LANDINGS_SQL}
SELECT year, id, {r('coalesce(sum(landed), 0)', 2)} AS landings FROM landed GROUP BY year, id""")
def sum_na_rm(spark, sf):
    return landed(spark, sf).groupBy("year", "id").agg(rnd(N.sum0("landed"), 2).alias("landings"))


ALL_TEMP_SQL = """temps AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, s_nationkey AS id, l_discount AS temp,
         CASE WHEN dayofyear(l_shipdate) > 91.5 AND dayofyear(l_shipdate) < 183 THEN 'spring'
              WHEN dayofyear(l_shipdate) >= 274.5 THEN 'fall' ELSE 'between' END AS season
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

TEMP_SQL = """temps AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN dayofyear(l_shipdate) < 183 THEN 'spring' ELSE 'fall' END AS season,
         s_nationkey AS id, l_discount AS temp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE (dayofyear(l_shipdate) > 91.5 AND dayofyear(l_shipdate) < 183) OR dayofyear(l_shipdate) >= 274.5)"""


def _season(day):
    return F.when(K.survey_days(day), K.season_from_day(day)).otherwise("between")


def all_temps(spark, sf):
    """Temperature readings by year, season (or between them) and area (supplier nation)."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("day"), F.col("l_discount").alias("temp"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("id"))
    return li.join(s, li.l_suppkey == s.s_suppkey).select("year", _season("day").alias("season"), "id", "temp")


def temps(spark, sf):
    """The readings of the two survey seasons."""
    return all_temps(spark, sf).where("season <> 'between'")


@query("mean_by_group", f"""WITH {ALL_TEMP_SQL}
SELECT year, season, id, {r('avg(temp)')} AS temp FROM temps GROUP BY ALL""")
def mean_by_group(spark, sf):
    return all_temps(spark, sf).groupBy("year", "season", "id").agg(rnd(F.avg("temp")).alias("temp"))


@query("mean_sd_by_group", f"""WITH {TEMP_SQL}
SELECT year, season, id, {r('avg(temp)')} AS mean_temp, {r('stddev_samp(temp)')} AS sd_temp
FROM temps GROUP BY ALL""")
def mean_sd_by_group(spark, sf):
    return A.mean_sd(temps(spark, sf), ["year", "season", "id"], "temp").select(
        "year", "season", "id", rnd("mean").alias("mean_temp"), rnd("sd").alias("sd_temp"))


@query("mean_na_rm_across", f"""SELECT l_partkey, {r('avg(CASE WHEN l_quantity > 5 THEN l_quantity END)')} AS l_quantity,
  {r('avg(l_extendedprice)')} AS l_extendedprice,
  {r('avg(CASE WHEN l_discount > 0 THEN l_discount END)')} AS l_discount
FROM lineitem GROUP BY l_partkey""")
def mean_na_rm_across(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_partkey", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(float("nan")).alias("l_discount"))
    cols = K.columns_of_type(li)
    out = A.mean_across(li, ["l_partkey"], cols)
    return K.across(out, cols, rnd)


@query("count_having", "SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def count_having(spark, sf):
    return A.count_having(table(spark, sf, "part"), ["p_name", "p_type"])


@query("count_distinct", """SELECT p_type, count(DISTINCT b) + max(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS n_distinct
FROM (SELECT p_type, nullif(p_brand, 'Brand#5') AS b FROM part) GROUP BY p_type""")
def count_distinct(spark, sf):
    df = table(spark, sf, "part").select("p_type", F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("b"))
    return A.count_distinct(df, ["p_type"], "b")


@query("five_number_summary", f"""SELECT {r('min(l_extendedprice)', 4)} AS min, {r('quantile_cont(l_extendedprice, 0.25)', 4)} AS q1,
  {r('quantile_cont(l_extendedprice, 0.5)', 4)} AS median, {r('avg(l_extendedprice)', 4)} AS mean,
  {r('quantile_cont(l_extendedprice, 0.75)', 4)} AS q3, {r('max(l_extendedprice)', 4)} AS max FROM lineitem""")
def five_number_summary(spark, sf):
    out = Q.five_numbers(table(spark, sf, "lineitem").select("l_extendedprice"), [], "l_extendedprice")
    return out.select(*[rnd(c, 4).alias(c) for c in out.columns])


@query("posterior_median_qi", f"""SELECT event_type AS param, {r('quantile_cont(value, 0.025)')} AS lower,
  {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.975)')} AS upper
FROM events GROUP BY event_type""")
def posterior_median_qi(spark, sf):
    draws = table(spark, sf, "events").select(F.col("event_type").alias("param"), "value")
    out = Q.median_interval(draws, ["param"], "value")
    return out.select("param", *[rnd(c).alias(c) for c in ("lower", "median", "upper")])


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("pairwise_correlation", "WITH x AS (SELECT nullif(l_quantity, 1) AS l_quantity, l_extendedprice, "
       "nullif(l_discount, 0) AS l_discount, l_tax, l_linenumber FROM lineitem) " + " UNION ALL ".join(
           f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS r FROM x"
           for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def pairwise_correlation(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("l_quantity"), "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"), "l_tax", "l_linenumber")
    return A.pairwise_correlation(df, CORR).withColumn("r", rnd("r"))


@query("histogram_bins", """SELECT least(CAST(floor(20 * (value - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS bin, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL""")
def histogram_bins(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20)


@query("standardize", f"""SELECT o_orderkey, {r('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)')} AS o_totalprice
FROM orders""")
def standardize(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.standardize(df, ["o_totalprice"]).withColumn("o_totalprice", rnd("o_totalprice"))


@query("decade_grid_mean", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}
SELECT tow, season, CASE WHEN y < 1980 THEN '1970-1979' WHEN y < 1990 THEN '1980-1989'
  WHEN y < 2000 THEN '1990-1999' WHEN y < 2010 THEN '2000-2009' ELSE '2010-2019' END AS decade,
  {r('avg(trait_size)')} AS mean_est
FROM (SELECT *, 1970 + 9 * (est_year - 1995) AS y FROM cwm) GROUP BY ALL""")
def decade_grid_mean(spark, sf):
    est = tow_cwm(spark, sf).withColumn("decade", K.decade(1970 + 9 * (F.col("est_year") - 1995)))
    return est.groupBy("tow", "season", "decade").agg(rnd(F.avg("trait_size")).alias("mean_est"))


@query("extent_bbox", f"""SELECT {r('min(lon) - 1')} AS xmin, {r('min(lat) - 2')} AS ymin, {r('max(lon) + 1')} AS xmax,
  {r('max(lat) + 0.5e0')} AS ymax FROM (SELECT -70 + 10 * CAST(embedding[1] AS DOUBLE) AS lon,
  40 + 10 * CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)""")
def extent_bbox(spark, sf):
    from .spatial import positions
    out = A.extent_bbox(positions(spark, sf), "lon", "lat")
    return out.select(*[rnd(c).alias(c) for c in out.columns])


_PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) AS n_distinct, "
    + (f"NULL AS min_number, NULL AS max_number, CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text" if t in ("string", "timestamp_ntz") else
       f"CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number, "
       f"CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text") + " FROM orders"
    for c, t in _PROFILE))
def column_profile(spark, sf):
    return A.column_profile(table(spark, sf, "orders").select(*[c for c, _ in _PROFILE]))


# ---- reshaping ------------------------------------------------------------------------------

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

SITE_TYPE_SQL = f"""{TOWS_SQL}, cells AS (
  SELECT tow, est_year, season, p_type AS grp, nullif(sum(biomass_kg), 50e0) AS biomass_kg
  FROM tows JOIN part ON svspp = p_partkey GROUP BY ALL)"""


def _cells(spark, sf):
    from ..operators.community import tow_totals
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("svspp"), F.col("p_type").alias("grp"))
    return (tow_totals(survey_catch(spark, sf)).join(p, "svspp")
            .groupBy("tow", "est_year", "season", "grp")
            .agg(F.nullif(F.sum("biomass_kg"), F.lit(50.0)).alias("biomass_kg")))


@query("pivot_wider_fill0", f"WITH {SITE_TYPE_SQL} SELECT tow, est_year, season, " + ", ".join(
    f"CASE WHEN count(*) FILTER (grp = '{t}') = 0 THEN 0e0 ELSE max(biomass_kg) FILTER (grp = '{t}') END AS \"{t}\""
    for t in TYPES) + " FROM cells GROUP BY tow, est_year, season")
def pivot_wider_fill0(spark, sf):
    return R.pivot_fill0(_cells(spark, sf), ["tow", "est_year", "season"], "grp", "biomass_kg", TYPES)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _metrics(spark, sf):
    return (table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type")
            .agg(F.max("value").alias("value")))


@query("pivot_wider_metric", "SELECT user_id, CAST(day(ts) AS INTEGER) AS day, " + ", ".join(
    f"max(value) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY ALL")
def pivot_wider_metric(spark, sf):
    return R.pivot_values(_metrics(spark, sf), ["user_id", "day"], "event_type", ["value"], EVENT_TYPES)


REGIONS = [0, 1, 2, 3, 4]


def _year_region(spark, sf):
    """Mean landings by year and region; one region reported 1999 with 1998, which leaves a gap."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    land = landed(spark, sf)
    return (land.join(n, land.id == n.n_nationkey)
            .withColumn("year", F.when((F.col("year") == 1999) & (F.col("n_regionkey") == 2), 1998).otherwise(F.col("year")))
            .groupBy("year", F.col("n_regionkey").alias("region")).agg(F.avg("landed").alias("y")))


@query("pivot_wider_mean_fill", f"""WITH {LANDINGS_SQL}, yr AS (
  SELECT CASE WHEN year = 1999 AND n_regionkey = 2 THEN 1998 ELSE year END AS year, n_regionkey AS region, avg(landed) AS y
  FROM landed JOIN nation ON id = n_nationkey GROUP BY ALL)
SELECT year, """ + ", ".join(
    r(f"coalesce(max(y) FILTER (region = {k}), (SELECT avg(y) FROM yr))", 4) + f' AS "{k}"' for k in REGIONS)
    + " FROM yr GROUP BY year")
def pivot_wider_mean_fill(spark, sf):
    out = R.pivot_mean_fill(_year_region(spark, sf), "year", "region", "y", REGIONS)
    return out.select("year", *[rnd(f"`{k}`", 4).alias(str(k)) for k in REGIONS])


@query("pivot_wider_multi", """SELECT user_id, """ + ", ".join(
    f"{r(f'avg(value) FILTER (event_type = {chr(39)}{t}{chr(39)})')} AS est_{t}, "
    f"min(value) FILTER (event_type = '{t}') AS lwr_{t}, max(value) FILTER (event_type = '{t}') AS upr_{t}"
    for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def pivot_wider_multi(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        rnd(F.avg("value")).alias("est"), F.min("value").alias("lwr"), F.max("value").alias("upr"))
    return R.pivot_values(g, ["user_id"], "event_type", ["est", "lwr", "upr"], EVENT_TYPES)


@query("pivot_longer", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}
SELECT tow, est_year, season, 'trait_size' AS pca_axis, {r('trait_size')} AS pca_value FROM cwm
UNION ALL SELECT tow, est_year, season, 'trait_price', {r('trait_price')} FROM cwm""")
def pivot_longer(spark, sf):
    long = R.pivot_longer(tow_cwm(spark, sf), ["tow", "est_year", "season"], TRAITS, "pca_axis", "pca_value")
    return long.withColumn("pca_value", rnd("pca_value"))


COMPLETE_SQL = """part_temps AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey AS svspp, avg(l_discount) AS temp FROM lineitem GROUP BY ALL)"""


@query("complete_grid", f"""WITH {COMPLETE_SQL}
SELECT y.year, i.svspp, {r('p.temp')} AS temp
FROM (SELECT DISTINCT year FROM part_temps) y CROSS JOIN (SELECT DISTINCT svspp FROM part_temps) i
LEFT JOIN part_temps p ON p.year = y.year AND p.svspp = i.svspp""")
def complete_grid(spark, sf):
    # many species were not caught in every year
    means = (table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("svspp"))
             .agg(F.avg("l_discount").alias("temp")))
    return R.complete_grid(means, ["year", "svspp"]).withColumn("temp", rnd("temp"))


@query("replicate_cross_join", """SELECT s_suppkey, est_year FROM supplier
CROSS JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS est_year FROM lineitem)""")
def replicate_cross_join(spark, sf):
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("est_year")).distinct()
    return R.replicate(table(spark, sf, "supplier").select("s_suppkey"), years)
