"""Queries that run whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import aggregates as A, spatial as G
from ..operators.reshape import pivot_values
from ..operators.trait_sources import RULES, SECOND_ONLY
from ..plans import areas, indicators, species as SP, trait_tables as TT
from .base import TOWS_SQL, TRAITS_SQL, query, r, rnd, survey_catch, table, traits
from .community import CWM_SQL, SITE, TRAITS, tow_cwm
from .joining import ROUNDED_SQL, SOURCES_SQL, TRAIT_COLS, source_a, source_b
from .modelling import GRIDFIELD_SQL, field_on_grid
from .spatial import AREAS_SQL, POS_SQL, UTM_SQL, area_edges, pip_sql, positions
from .summaries import LANDINGS_SQL, landed


def tow_positions(spark, sf):
    return positions(spark, sf).withColumnRenamed("vec_id", "tow")


PLACED_SQL = f"{POS_SQL}, {AREAS_SQL}, placed AS (SELECT vec_id AS tow, m.poly_id AS area FROM pos LEFT JOIN {pip_sql('pos', 'vec_id')} m USING (vec_id))"

AREA_CWM_SQL = f"""{TOWS_SQL}, {TRAITS_SQL}, {PLACED_SQL}, by_area AS (
  SELECT est_year, season, area, svspp, coalesce(sum(biomass_kg), 0) AS biomass_kg FROM tows LEFT JOIN placed USING (tow) GROUP BY ALL),
area_cwm AS (SELECT est_year, season, area, sum(biomass_kg * trait_size) / nullif(sum(biomass_kg), 0e0) AS trait_size,
    sum(biomass_kg * trait_price) / nullif(sum(biomass_kg), 0e0) AS trait_price
  FROM by_area JOIN traits USING (svspp) WHERE trait_size IS NOT NULL GROUP BY ALL)"""


def area_cwm(spark, sf):
    return areas.cwm_by_area(survey_catch(spark, sf), tow_positions(spark, sf), area_edges(spark, sf),
                             traits(spark, sf), TRAITS)


@query("cwm_by_area", f"WITH {AREA_CWM_SQL} SELECT est_year, season, area, {r('trait_size')} AS trait_size, {r('trait_price')} AS trait_price FROM area_cwm")
def cwm_by_area(spark, sf):
    return area_cwm(spark, sf).select("est_year", "season", "area", *[rnd(c).alias(c) for c in TRAITS])


@query("cwm_by_tow", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}
SELECT tow, est_year, season, {r('trait_size')} AS trait_size, {r('trait_price')} AS trait_price, s_name, s_nationkey
FROM cwm LEFT JOIN supplier ON tow = s_suppkey""")
def cwm_by_tow(spark, sf):
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tow"), "s_name", "s_nationkey")
    out = areas.cwm_by_tow(survey_catch(spark, sf), meta, ["s_name", "s_nationkey"], traits(spark, sf), TRAITS)
    return out.select(*SITE, *[rnd(c).alias(c) for c in TRAITS], "s_name", "s_nationkey")


# ---- species and traits ---------------------------------------------------------------------

TAXA_SQL = """taxa AS (SELECT p_name || ' ' || p_partkey AS species,
    upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS genus, split_part(p_name, ' ', 2) AS subfamily,
    substr(p_type, 1, 1) || lower(substr(p_type, 2)) AS family, p_brand AS "order", CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS class,
    'all' AS super_class FROM part),
look AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY matched, genus NULLS FIRST,
    subfamily NULLS FIRST, family NULLS FIRST, "order", class, super_class) AS rn FROM (
  SELECT genus AS name, 0 AS matched, genus, subfamily, family, "order", class, super_class FROM taxa
  UNION ALL SELECT family, 1, NULL, NULL, family, "order", class, super_class FROM taxa
  UNION ALL SELECT "order", 2, NULL, NULL, NULL, "order", class, super_class FROM taxa)) WHERE rn = 1),
raw AS (SELECT p_partkey AS svspp, p_size, p_brand, p_name || ' ' || p_partkey AS species, CASE WHEN p_size = 50 THEN 'UNKNOWN 04'
    WHEN p_size = 49 THEN p_type || ' SP' WHEN p_size = 48 THEN 'ZZZ 1' ELSE upper(p_name) || ' ' || p_partkey END AS sciname FROM part),
named AS (SELECT *, substr(sciname, 1, 1) || lower(substr(sciname, 2)) AS label FROM raw WHERE svspp IN (SELECT l_partkey FROM lineitem)),
kept AS (SELECT * FROM named WHERE label <> 'Unknown 04' AND label NOT IN (SELECT label FROM named WHERE p_brand = 'Brand#9' AND p_size < 48)),
syn AS (SELECT DISTINCT label, species AS validated_species FROM named WHERE p_size <= 30)"""


def _taxa(spark, sf):
    return table(spark, sf, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("species"), K.sentence_case(K.word("p_name", 0)).alias("genus"),
        K.word("p_name", 1).alias("subfamily"), K.sentence_case("p_type").alias("family"), F.col("p_brand").alias("order"),
        F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("class"), F.lit("all").alias("super_class"))


@query("species_list", f"""WITH {TAXA_SQL}
SELECT svspp, kept.label, validated_species, genus, subfamily, family, "order", class, super_class
FROM kept JOIN syn USING (label) LEFT JOIN taxa ON taxa.species = validated_species
UNION ALL SELECT svspp, kept.label, NULL, genus, subfamily, family, "order", class, super_class
FROM kept LEFT JOIN syn USING (label) JOIN look ON name = split_part(label, ' ', 1) WHERE validated_species IS NULL""")
def species_list(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    own = F.concat_ws(" ", F.upper("p_name"), "p_partkey")
    names = p.select(F.col("p_partkey").alias("svspp"),
                     F.when(size == 50, "UNKNOWN 04").when(size == 49, F.concat_ws(" ", "p_type", F.lit("SP")))
                     .when(size == 48, "ZZZ 1").otherwise(own).alias("sciname"))
    own_label = K.sentence_case(own)
    synonyms = p.where("p_size <= 30").select(
        own_label.alias("label"), F.concat_ws(" ", "p_name", "p_partkey").alias("validated_species"))
    other = p.where("p_brand = 'Brand#9' AND p_size < 48").select(own_label.alias("label"))
    codes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("svspp"))
    return SP.species_list(codes, names, synonyms, _taxa(spark, sf), other)


def _text_key(df):
    return df.withColumn("species", F.col("species").cast("string"))


def trait_db(spark, sf):
    listed = table(spark, sf, "part").select(
        F.col("p_partkey").alias("svspp"), F.concat_ws(" ", "p_partkey", F.lit("spp")).alias("label"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_partkey").cast("string")).alias("species"))
    return TT.trait_database(listed, _text_key(source_a(spark, sf)), _text_key(source_b(spark, sf)))


_ALONE = ", ".join([f"{r(t)} AS {t}" for t in TRAIT_COLS] + [f"NULL AS {x.level}, 'B' AS {x.reference}" for x in RULES]
                   + [f"'B' AS {ref}" for ref in SECOND_ONLY.values()])


@query("trait_database", f"""WITH {SOURCES_SQL} SELECT * REPLACE (CAST(species AS VARCHAR) AS species, {ROUNDED_SQL}), species AS svspp, species || ' spp' AS label FROM filled
UNION ALL BY NAME SELECT CAST(NULL AS VARCHAR) AS species, CAST(NULL AS VARCHAR) AS area, {_ALONE}, species AS svspp, species || ' spp' AS label FROM b
WHERE species IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')""")
def trait_database(spark, sf):
    return K.across(trait_db(spark, sf), TRAIT_COLS, rnd)


def fitted_components(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("svspp"), F.col("p_retailprice").alias("retail"),
                                        F.col("p_size").cast("double").alias("size"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("svspp"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), (F.col("l_tax") + 0.01).alias("tax"))
    return TT.trait_pca(li.join(p, "svspp"), "svspp", _COMPONENT_TRAITS, len(_COMPONENT_TRAITS))


@query("trait_pca")
def trait_pca(spark, sf):
    return fitted_components(spark, sf)[1].select("svspp", "PC1", "PC2", "PC3")


_COMPONENT_TRAITS = ["retail", "size", "quantity", "price", "tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COMPONENT_TRAITS) for b in _COMPONENT_TRAITS[i + 1:]]


# The eigenvalues of a correlation matrix add up to its size and their squares to its squared elements; scores have mean 0,
# the eigenvalues as variances, and for each species the squared length of its standardized traits.
@query("trait_pca_moments", f"""WITH t AS (SELECT l_partkey AS svspp, ln(any_value(p_retailprice)) AS retail, ln(any_value(p_size)) AS size,
  ln(avg(l_quantity)) AS quantity, ln(avg(l_extendedprice)) AS price, ln(avg(l_tax + 0.01)) AS tax FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey),
m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _COMPONENT_TRAITS)},
  count(*) AS n, {len(_COMPONENT_TRAITS)}e0 + 2 * ({" + ".join(f"corr({a}, {b}) ** 2" for a, b in _PAIRS)}) AS sq FROM t)
SELECT CAST(NULL AS BIGINT) AS svspp, 'sum of variances' AS what, {len(_COMPONENT_TRAITS)}e0 AS value FROM m
UNION ALL SELECT NULL, 'sum of squared variances', {r('sq')} FROM m UNION ALL SELECT NULL, 'sum of shares', 1e0 FROM m
UNION ALL SELECT svspp, 'squared length', {r(" + ".join(f"(({c} - m_{c}) / s_{c}) ** 2" for c in _COMPONENT_TRAITS), 4)} FROM t, m""")
def trait_pca_moments(spark, sf):
    fit, scores = fitted_components(spark, sf)
    v = [float(x) for x in fit.variance]
    told = [("sum of variances", sum(v)), ("sum of squared variances", sum(x * x for x in v)), ("sum of shares", float(fit.proportion.sum()))]
    head = spark.createDataFrame(told, "what string, value double").select(
        F.lit(None).cast("bigint").alias("svspp"), "what", rnd("value").alias("value"))
    pcs = [F.col(f"PC{k + 1}") for k in range(len(_COMPONENT_TRAITS))]
    lengths = scores.select("svspp", F.lit("squared length").alias("what"), rnd(sum((c * c for c in pcs[1:]), pcs[0] * pcs[0]), 4).alias("value"))
    return head.unionByName(lengths)


# ---- areas ----------------------------------------------------------------------------------

BT_SQL = f"""{PLACED_SQL}, bt AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN dayofyear(l_shipdate) < 183 THEN 'spring' ELSE 'fall' END AS season,
  area, avg(l_discount) AS mean_temp, stddev_samp(l_discount) AS sd_temp FROM lineitem JOIN placed ON l_suppkey = tow
  WHERE area IS NOT NULL AND ((dayofyear(l_shipdate) > 91.5 AND dayofyear(l_shipdate) < 183) OR dayofyear(l_shipdate) >= 274.5) GROUP BY ALL)"""


def bottom_temps(spark, sf):
    grid = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tow"), F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("day"),
        F.col("l_discount").alias("temp"))
    return areas.bottom_temp_by_area(grid, tow_positions(spark, sf), area_edges(spark, sf), "tow")


@query("bottom_temp_by_area", f"WITH {BT_SQL} SELECT year, season, area, {r('mean_temp')} AS mean_temp, {r('sd_temp')} AS sd_temp FROM bt")
def bottom_temp_by_area(spark, sf):
    return bottom_temps(spark, sf).select("year", "season", "area", rnd("mean_temp").alias("mean_temp"), rnd("sd_temp").alias("sd_temp"))


@query("area_model_table", f"""WITH {AREA_CWM_SQL}, {BT_SQL[len(PLACED_SQL) + 2:]}, {LANDINGS_SQL},
la AS (SELECT year, id, coalesce(sum(landed), 0) AS landings FROM landed GROUP BY ALL),
m AS (SELECT est_year AS year, lower(season) AS season, area AS id, trait_size, trait_price FROM area_cwm),
g AS (SELECT * FROM (SELECT DISTINCT year FROM m), (SELECT DISTINCT id FROM m), (SELECT DISTINCT season FROM m)),
w AS (SELECT g.year, g.id, g.season, trait_size, trait_price, CASE WHEN m.year IS NOT NULL THEN mean_temp END AS mean_temp,
    CASE WHEN m.year IS NOT NULL THEN sd_temp END AS sd_temp, landings
  FROM g LEFT JOIN m ON m.year = g.year AND m.id = g.id AND m.season = g.season
  LEFT JOIN bt ON bt.year = g.year AND bt.area = g.id AND bt.season = g.season LEFT JOIN la ON la.year = g.year AND la.id = g.id
  WHERE g.id IS NOT NULL),
k AS (SELECT *, mean_temp / nullif(sd_temp, 0) AS cv_temp FROM w WHERE coalesce(trait_size, trait_price, mean_temp, sd_temp, landings) IS NOT NULL)
SELECT year, id, season, CAST(year AS DOUBLE) AS time, CAST(year AS VARCHAR) AS year_fct, CAST(id AS VARCHAR) AS stat_area, {r('mean_temp')} AS mean_temp, {r('cv_temp')} AS cv_temp, {r('CASE WHEN landings > 0 THEN ln(landings) END')} AS log_landings, 'trait_size' AS pca_axis, {r('trait_size')} AS pca_value FROM k
UNION ALL SELECT year, id, season, CAST(year AS DOUBLE), CAST(year AS VARCHAR), CAST(id AS VARCHAR), {r('mean_temp')}, {r('cv_temp')}, {r('CASE WHEN landings > 0 THEN ln(landings) END')}, 'trait_price', {r('trait_price')} FROM k""")
def area_model_table(spark, sf):
    means = (area_cwm(spark, sf)
             .select(F.col("est_year").alias("year"), F.lower("season").alias("season"), F.col("area").alias("id"), *TRAITS))
    temps = bottom_temps(spark, sf).withColumnRenamed("area", "id")
    la = (landed(spark, sf).groupBy("year", "id")
          .agg(F.coalesce(F.sum("landed"), F.lit(0.0)).alias("landings")))
    out = areas.area_model_table(means, temps, la, TRAITS)
    return out.select("year", "id", "season", "time", "year_fct", "stat_area", rnd("mean_temp").alias("mean_temp"), rnd("cv_temp").alias("cv_temp"),
                      rnd("log_landings").alias("log_landings"), "pca_axis", rnd("pca_value").alias("pca_value"))


# ---- stock tables ---------------------------------------------------------------------------

_STOCK = {  # table: (condition, {column: expression in both engines})
    "maturity": ("l_returnflag = 'A'", {"tm": "nullif(l_quantity, 7e0)", "lm": "nullif(l_discount, 0e0)"}),
    "fecundity": ("l_returnflag = 'N'", {"fecundity_min": "CASE WHEN l_quantity > 10 THEN l_extendedprice END",
                                         "fecundity_max": "CASE WHEN l_quantity < 40 THEN l_extendedprice * 2 END"}),
    "popchar": ("l_linestatus = 'O'", {"wmax": "l_extendedprice", "lmax": "l_quantity", "tmax": "CAST(l_linenumber AS DOUBLE)"}),
    "popgrowth": ("l_linestatus = 'F'", {"loo": "l_quantity", "k": "nullif(l_discount, 0e0)", "winfinity": "l_extendedprice",
                                         "tmax": "CAST(l_linenumber AS DOUBLE)", "rm": "l_tax"}),
    "eggs": ("l_linenumber <= 3", {"eggdiammin": "CASE WHEN l_quantity > 25 THEN l_tax END", "eggdiammax": "CASE WHEN l_quantity > 20 THEN l_tax + 1 END",
                                   "eggdiammod": "l_tax + 5"}),
}


def _stock_sql(name):
    cond, cols = _STOCK[name]
    avgs = ", ".join(f"avg({e}) AS {c}" for c, e in cols.items())
    return (f"{name} AS (SELECT * FROM (SELECT l_partkey AS spec_code, l_suppkey AS stock_code, {avgs} FROM lineitem WHERE {cond} GROUP BY ALL) "
            f"WHERE coalesce({', '.join(cols)}) IS NOT NULL)")


_STOCK_OUT = ["tm", "lm", "fecundity_mean", "trophic_num", "wmax", "lmax", "tmax", "loo", "k", "winfinity", "tmax_growth", "rm", "egg_dia"]


@query("fishbase_stock_traits", "WITH " + ", ".join(_stock_sql(n) for n in _STOCK) + f""", eco AS (
  SELECT p_partkey AS spec_code, s_suppkey AS stock_code, p_type AS schooling, coalesce(nullif(p_size, 5), s_nationkey) AS troph
  FROM part JOIN supplier ON s_suppkey = p_size)
SELECT m.spec_code, m.stock_code, eco.schooling, """ + ", ".join(f"{r(e)} AS {c}" for c, e in {
    **{c: c for c in _STOCK_OUT}, "tm": "tm", "fecundity_mean": "CASE WHEN fecundity_min IS NULL THEN fecundity_max WHEN fecundity_max IS NULL THEN fecundity_min ELSE (fecundity_min + fecundity_max) / 2 END",
    "trophic_num": "eco.troph", "tmax": "pc.tmax", "tmax_growth": "pg.tmax",
    "egg_dia": "CASE WHEN eggdiammin IS NULL AND eggdiammax IS NULL THEN eggdiammod WHEN eggdiammin IS NULL THEN eggdiammax WHEN eggdiammax IS NULL THEN eggdiammin ELSE (eggdiammin + eggdiammax) / 2 END"}.items())
    + """ FROM maturity m LEFT JOIN fecundity USING (spec_code, stock_code) LEFT JOIN eco USING (spec_code, stock_code)
LEFT JOIN popchar pc USING (spec_code, stock_code) LEFT JOIN popgrowth pg USING (spec_code, stock_code) LEFT JOIN eggs USING (spec_code, stock_code)
WHERE m.stock_code IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""")
def stock_traits(spark, sf):
    li = table(spark, sf, "lineitem")

    def stock(name):
        cond, cols = _STOCK[name]
        return li.where(cond).selectExpr("l_partkey AS spec_code", "l_suppkey AS stock_code",
                                         *[f"{e} AS {c}" for c, e in cols.items()])
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    eco = p.join(s, F.col("s_suppkey") == F.col("p_size")).select(
        F.col("p_partkey").alias("spec_code"), F.col("s_suppkey").alias("stock_code"), F.col("p_type").alias("schooling"),
        F.nullif(F.col("p_size"), F.lit(5)).alias("diet_troph"), F.col("s_nationkey").alias("food_troph"))
    stocks = s.where("s_nationkey < 12").select(F.col("s_suppkey").alias("stock_code"))
    out = TT.stock_traits(stock("maturity"), stock("fecundity"), eco, stock("popchar"), stock("popgrowth"), stock("eggs"), stocks)
    return out.select("spec_code", "stock_code", "schooling", *[rnd(c).alias(c) for c in _STOCK_OUT])


# ---- summaries and series -------------------------------------------------------------------

@query("litreview_frequency", "SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def litreview_frequency(spark, sf):
    return A.count_having(table(spark, sf, "events"), ["event_type", "props"])


_EAV_SQL = f"""{LANDINGS_SQL}, told AS (SELECT CASE WHEN year = 1999 AND n_regionkey = 2 THEN 1998 ELSE year END AS year, n_regionkey AS region, landed, id
  FROM landed JOIN nation ON id = n_nationkey),
base AS (SELECT year, region, avg(landed) / 1e5 AS y, count(*) AS harvest,
    avg(id) AS temp, CAST(year - 1990 AS DOUBLE) AS gsi FROM told GROUP BY ALL),
b AS (SELECT *, (harvest - (SELECT avg(harvest) FROM base)) / (SELECT stddev_samp(harvest) FROM base) AS h FROM base)"""
_REGIONS = [0, 1, 2, 3, 4]


@query("state_space_inputs", f"WITH {_EAV_SQL} SELECT year, max(gsi) AS gsi, " + ", ".join(
    f"{r(f'coalesce(max(temp) FILTER (region = {k}), (SELECT avg(temp) FROM b))')} AS temp_{k}, "
    f"{r(f'coalesce(max(h) FILTER (region = {k}), 0)')} AS harvest_{k}, "
    f"{r(f'coalesce(max(y) FILTER (region = {k}), (SELECT avg(y) FROM b))')} AS y_{k}, "
    f"{r(f'(SELECT max(y) FROM b WHERE region = {k} AND year = (SELECT min(year) FROM b))')} AS x0_{k}" for k in _REGIONS) + " FROM b GROUP BY year")
def state_space_inputs(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    land = landed(spark, sf)
    told = F.when((F.col("year") == 1999) & (F.col("n_regionkey") == 2), 1998).otherwise(F.col("year"))  # one region was late
    g = (land.join(n, land.id == n.n_nationkey).withColumn("year", told)
         .groupBy("year", F.col("n_regionkey").alias("region"))
         .agg((F.avg("landed") / 1e5).alias("Y"), F.count("*").cast("double").alias("Harvest"), F.avg("id").alias("Temp")))
    wide = g.withColumn("GSI", (F.col("year") - 1990).cast("double"))
    eav = wide.unpivot(["year", "region"], ["Y", "Harvest", "Temp", "GSI"], "metric", "value")
    out = indicators.state_space_inputs(eav, ["Y", "Harvest", "Temp", "GSI"], _REGIONS)
    cols = [c for c in out.columns if c not in ("year", "gsi")]
    return out.select("year", "gsi", *[rnd(c).alias(c) for c in cols])


@query("cog_shift", f"""WITH {GRIDFIELD_SQL} SELECT est_year, {r('1000 * sum(cx * est) / sum(est)', 3)} AS "X", {r('1000 * sum(cy * est) / sum(est)', 3)} AS "Y"
FROM onto GROUP BY est_year""")
def cog_shift(spark, sf):
    cog = G.center_of_gravity(field_on_grid(spark, sf), "est_year", "est")
    wide = pivot_values(cog, ["est_year"], "coord", ["est"], ["X", "Y"])
    return wide.select("est_year", *[rnd(F.col(c) * 1000, 3).alias(c) for c in ("X", "Y")])


@query("indicator_series", f"""WITH rows_ AS (SELECT user_id, value, CAST(strftime(ts, '%j') AS DOUBLE) AS time_point, event_id FROM events
  WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')),
f AS (SELECT user_id, row_number() OVER (ORDER BY avg(value), user_id) AS facet FROM rows_ GROUP BY user_id)
SELECT event_id, user_id AS area, value, time_point, facet FROM rows_ JOIN f USING (user_id)""")
def indicator_series(spark, sf):
    eav = table(spark, sf, "events").select(
        "event_id", F.concat_ws("_", F.lit("day"), F.date_format("ts", "DDD")).alias("time"),
        F.col("event_type").alias("var"), "value", F.col("user_id").alias("area"))
    out = indicators.indicator_series(
        eav, "purchase", table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("area")))
    return out.select("event_id", "area", "value", "time_point", "facet")


@query("covariate_enriched_tows", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}, {UTM_SQL}
SELECT CAST(s_nationkey AS VARCHAR) || CASE WHEN tow < 1000 THEN lpad(CAST(tow AS VARCHAR), 3, '0') ELSE CAST(tow AS VARCHAR) END || CAST(s_nationkey AS VARCHAR) AS id,
  est_year, upper(season) AS season, {r('trait_size')} AS trait_size, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS depth, {r('x')} AS x, {r('y')} AS y
FROM cwm JOIN supplier ON tow = s_suppkey JOIN utm ON tow = vec_id""")
def covariate_enriched_tows(spark, sf):
    s = table(spark, sf, "supplier")
    stations = s.select(F.col("s_suppkey").alias("tow"), F.col("s_nationkey").alias("cruise"),
                        F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("stratum"))
    pos = positions(spark, sf)
    cov = (s.join(pos, F.col("s_suppkey") == F.col("vec_id"))
           .select(K.composite_id("s_nationkey", "s_suppkey", "s_nationkey").alias("id"),
                   F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("depth"), "lon", "lat"))
    out = areas.covariate_tows(tow_cwm(spark, sf), stations, cov)
    return out.select("id", "est_year", "season", rnd("trait_size").alias("trait_size"), "depth",
                      rnd("X").alias("x"), rnd("Y").alias("y"))
