"""Queries on joins, hierarchies and trait sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import joins as J, ordering as O, taxonomy as X, trait_sources as T
from .base import CATCH_SQL, TOWS_SQL, TRAITS_SQL, query, r, rnd, survey_catch, table
from .community import CWM_SQL, SITE, tow_cwm

KEYED_SQL = """sup AS (SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS nk FROM supplier),
nat AS (SELECT CASE WHEN n_nationkey <> 7 THEN n_nationkey END AS k, n_name FROM nation)"""


def _keyed(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("nk"))
    n = table(spark, sf, "nation").select(
        F.nullif(F.col("n_nationkey"), F.lit(7)).alias("k"), "n_name")
    return s, n


@query("left_join_keyed", f"WITH {KEYED_SQL} SELECT s_suppkey, nk, n_name FROM sup LEFT JOIN nat ON nk IS NOT DISTINCT FROM k")
def left_join_keyed(spark, sf):
    return J.null_safe_join(*_keyed(spark, sf), {"nk": "k"})


@query("left_join_natural", """SELECT n_regionkey, c.c_nationkey, c.n, s.bal FROM
  (SELECT c_nationkey, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
   GROUP BY ALL) c
LEFT JOIN (SELECT nullif(s_nationkey, 3) AS c_nationkey, round(sum(s_acctbal) + 1e-5, 2) AS bal FROM supplier
           GROUP BY ALL) s USING (c_nationkey)""")
def left_join_natural(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = (table(spark, sf, "customer").join(n, "c_nationkey")
         .groupBy("c_nationkey", "n_regionkey").agg(F.count("*").alias("n")))
    # one nation's suppliers have no key, so that nation stays without a balance
    s = (table(spark, sf, "supplier").groupBy(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("c_nationkey"))
         .agg(F.round(F.sum("s_acctbal") + F.lit(1e-5), 2).alias("bal")))
    return J.natural_join(c, s, ["c_nationkey"])


STOCK_ARMS = {  # arm: (condition, {column: measure})
    "maturity": ("l_returnflag = 'A'", {"tm": "l_quantity", "lm": "l_discount"}),
    "fecundity": ("l_returnflag = 'N'", {"fecundity_mean": "l_extendedprice"}),
    "ecology": ("l_returnflag = 'R'", {"trophic_num": "l_tax"}),
    "popchar": ("l_linestatus = 'O'", {"wmax": "l_extendedprice", "lmax": "l_quantity", "tmax": "l_linenumber"}),
    "popgrowth": ("l_linestatus = 'F'", {"loo": "l_quantity", "k": "l_discount", "tmax_growth": "l_linenumber"}),
    "eggs": ("l_linenumber <= 3", {"egg_dia": "l_tax"}),
}


def stock_arm(spark, sf, name):
    cond, cols = STOCK_ARMS[name]
    return (table(spark, sf, "lineitem").where(cond)
            .groupBy(F.col("l_partkey").alias("spec_code"), F.col("l_suppkey").alias("stock_code"))
            .agg(*[F.avg(m).alias(c) for c, m in cols.items()]))


def stock_arm_sql(name):
    cond, cols = STOCK_ARMS[name]
    ms = ", ".join(f"avg({m}) AS {c}" for c, m in cols.items())
    return (f"{name} AS (SELECT l_partkey AS spec_code, l_suppkey AS stock_code, {ms} FROM lineitem "
            f"WHERE {cond} GROUP BY ALL)")


_MEASURES = [c for _, cols in STOCK_ARMS.values() for c in cols]


@query("star_join_stock_traits", "WITH " + ", ".join(stock_arm_sql(a) for a in STOCK_ARMS) + " SELECT spec_code, stock_code, "
       + ", ".join(f"{r(c)} AS {c}" for c in _MEASURES) + " FROM maturity "
       + " ".join(f"LEFT JOIN {a} USING (spec_code, stock_code)" for a in list(STOCK_ARMS)[1:])
       + " WHERE stock_code IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def star_join_stock_traits(spark, sf):
    first, *rest = STOCK_ARMS
    stocks = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("stock_code"))
    center = J.members(stock_arm(spark, sf, first), stocks, "stock_code")
    out = J.star_join(center, [stock_arm(spark, sf, a) for a in rest], ["spec_code", "stock_code"])
    return out.select("spec_code", "stock_code", *[rnd(c).alias(c) for c in _MEASURES])


@query("right_join", """SELECT o_orderkey, c_custkey, c_mktsegment FROM orders
RIGHT JOIN customer ON o_custkey = c_custkey""")
def right_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "right").drop("o_custkey")


@query("semi_join_membership", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_membership(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return J.members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey")


@query("anti_join_membership", """SELECT p_partkey, k FROM (SELECT p_partkey, nullif(p_size, 4) AS k FROM part)
WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = k)""")
def anti_join_membership(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(4)).alias("k"))
    return J.non_members(p, table(spark, sf, "nation"), "k", "n_nationkey")


@query("three_way_membership", """WITH l AS (SELECT DISTINCT p_partkey AS k FROM part),
a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity <= 48)
SELECT k, CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN 'both'
  WHEN k IN (SELECT k FROM a) THEN 'only_a' ELSE 'only_b' END AS membership
FROM l WHERE k IN (SELECT k FROM a) OR k IN (SELECT k FROM b)""")
def three_way_membership(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    k = F.col("p_partkey").alias("k")
    caught = F.col("l_partkey").alias("k")  # in large hauls and in the others
    return J.classify_membership(p.select(k), li.where("l_quantity > 48").select(caught),
                                 li.where("l_quantity <= 48").select(caught), "k")


# ---- hierarchy ------------------------------------------------------------------------------

TAXONOMY_SQL = """taxonomy AS (SELECT p_name || ' ' || p_partkey AS species, split_part(p_name, ' ', 1) AS genus,
  split_part(p_name, ' ', 2) AS subfamily, p_type AS family, p_brand AS "order",
  CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS class, 'all' AS super_class FROM part),
lookup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY matched, genus NULLS FIRST,
    subfamily NULLS FIRST, family NULLS FIRST, "order", class, super_class) AS rn FROM (
  SELECT genus AS name, 0 AS matched, genus, subfamily, family, "order", class, super_class FROM taxonomy
  UNION ALL SELECT family, 1, NULL, NULL, family, "order", class, super_class FROM taxonomy
  UNION ALL SELECT "order", 2, NULL, NULL, NULL, "order", class, super_class FROM taxonomy)) WHERE rn = 1)"""


def taxonomy(spark, sf):
    return table(spark, sf, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("species"), K.word("p_name", 0).alias("genus"),
        K.word("p_name", 1).alias("subfamily"), F.col("p_type").alias("family"),
        F.col("p_brand").alias("order"),
        F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("class"),
        F.lit("all").alias("super_class"))


def _labels(spark, sf):
    """Labels of all ranks, with some that no rank knows."""
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    return (p.select("p_partkey", K.word("p_name", 0).alias("label"))
            .union(p.select("p_partkey", "p_type")).union(p.select("p_partkey", "p_brand"))
            .union(c.select("c_custkey", "c_mktsegment")).toDF("id", "label"))


LABELS_SQL = """labels_ AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS label FROM part
  UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, p_brand FROM part
  UNION ALL SELECT c_custkey, c_mktsegment FROM customer)"""


@query("rank_fallback_join", f"""WITH {TAXONOMY_SQL}, {LABELS_SQL}
SELECT id, label, CASE matched WHEN 0 THEN 'genus' WHEN 1 THEN 'family' ELSE 'order' END AS matched,
  genus, subfamily, family, "order", class, super_class FROM labels_ JOIN lookup ON label = name""")
def rank_fallback_join(spark, sf):
    return X.rank_fallback_join(_labels(spark, sf), "label", taxonomy(spark, sf), keep_rank=True)


# ---- enrichment -----------------------------------------------------------------------------

@query("enrich_back_metadata", f"""WITH {CATCH_SQL}
SELECT tow, est_year, season, sum(biomass_kg) AS biomass_kg, s_nationkey, s_name FROM catch
LEFT JOIN supplier ON tow = s_suppkey GROUP BY ALL""")
def enrich_back_metadata(spark, sf):
    rows = survey_catch(spark, sf).groupBy(*SITE).agg(F.sum("biomass_kg").alias("biomass_kg"))
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tow"), "s_nationkey", "s_name")
    return J.enrich_back(rows, meta, ["tow"], ["s_nationkey", "s_name"])


@query("bind_cols_keyed", f"""WITH {TOWS_SQL}, {TRAITS_SQL}, {CWM_SQL}
SELECT tow, est_year, season, {r('trait_size')} AS trait_size, total FROM cwm
JOIN (SELECT tow, est_year, season, sum(biomass_kg) AS total FROM tows GROUP BY ALL) USING (tow, est_year, season)""")
def bind_cols_keyed(spark, sf):
    from ..operators.community import row_total, tow_totals
    total = row_total(tow_totals(survey_catch(spark, sf)), SITE, "biomass_kg")
    return (tow_cwm(spark, sf).join(total, SITE)
            .select(*SITE, rnd("trait_size").alias("trait_size"), "total"))


def covariates(spark, sf):
    """Environmental covariates by station id; stations in debt have no depth."""
    s = table(spark, sf, "supplier")
    return s.select(K.composite_id("s_nationkey", "s_suppkey", "s_nationkey").alias("id"),
                    F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("depth"))


COVARIATES_SQL = """covs AS (SELECT CAST(s_nationkey AS VARCHAR) || CASE WHEN s_suppkey < 1000
    THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END || CAST(s_nationkey AS VARCHAR) AS id,
  CASE WHEN s_acctbal > 0 THEN s_acctbal END AS depth, s_suppkey FROM supplier)"""


@query("composite_id_join", f"""WITH {COVARIATES_SQL}
SELECT l_suppkey AS station, count(*) AS n, any_value(covs.id) AS id, any_value(depth) AS depth
FROM lineitem LEFT JOIN covs ON l_suppkey = s_suppkey GROUP BY l_suppkey""")
def composite_id_join(spark, sf):
    n = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("station"))
         .agg(F.count("*").alias("n")))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), "s_nationkey")
    tows = n.join(s, "station").withColumn("key", K.composite_id("s_nationkey", "station", "s_nationkey"))
    cov = covariates(spark, sf)
    return (tows.join(cov, tows.key == cov.id, "left").select("station", "n", "id", "depth"))


# ---- two trait sources ----------------------------------------------------------------------

# Traits of the first source: column -> expression over a species' catches of one return flag.
_A_TRAITS = {"trophic_level": "avg(l_quantity)", "age_maturity": "avg(l_linenumber)", "fecundity": "avg(l_discount)", "l_inf": "avg(l_extendedprice)",
             "k": "avg(l_tax)", "max_obs_length": "max(l_quantity)", "offspring_size": "min(l_tax) + 0.01"}
# Level codes by the number of catches, so that every rule meets species at its level and others.
_A_LEVELS = {
    "level_tl": "CASE WHEN count(*) >= 9 THEN 'spe' WHEN count(*) >= 6 THEN 'gen' END",
    "level_age_maturity": "CASE WHEN count(*) >= 10 THEN 'spe-ocean' WHEN count(*) >= 7 THEN 'fam' END",
    "level_fecundity": "CASE WHEN count(*) >= 12 THEN 'spe-LME' WHEN count(*) >= 7 THEN 'spe' WHEN count(*) >= 5 THEN 'fam' END",
    "level_growth": "CASE WHEN count(*) >= 11 THEN 'spe-FAO' WHEN count(*) >= 8 THEN 'gen' END",
    "level_length_max": "CASE WHEN count(*) >= 5 THEN 'spe' END",
    "level_offspring_size": "CASE WHEN count(*) >= 8 THEN 'spe-LME' WHEN count(*) >= 6 THEN 'ord' END"}
_B_TRAITS = {"trophic_level": "CAST(p_size AS DOUBLE)", "age_maturity": "p_size / 10e0", "fecundity": "p_retailprice", "l_inf": "p_retailprice * 2",
             "k": "p_size / 100e0", "max_obs_length": "p_retailprice / 10", "offspring_size": "p_size * 0.5e0", "temperature": "p_size * 2.5e0",
             "w_inf": "p_retailprice / 3", "natural_mortality": "p_size / 50e0", "length_maturity": "p_retailprice / 4"}
# every species is in a source: small ones in the first, large ones in the second, those between in both
_IN_A, _IN_B = "p_size <= 30", "p_size >= 15"


def source_a(spark, sf):
    """Several rows per species (one per return flag), levels from the number of records."""
    exprs = {**_A_TRAITS, **_A_LEVELS}
    g = (table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(*[F.expr(e).alias(c) for c, e in exprs.items()]))
    p = table(spark, sf, "part").where(_IN_A).select("p_partkey")
    return g.join(p, g.l_partkey == p.p_partkey).select(
        F.col("l_partkey").alias("species"), F.col("l_returnflag").alias("area"), *exprs, *[F.lit("A").alias(r.reference) for r in T.RULES])


def source_b(spark, sf):
    return table(spark, sf, "part").where(_IN_B).selectExpr("p_partkey AS species", *[f"{e} AS {c}" for c, e in _B_TRAITS.items()])


def _sources_sql() -> str:
    flags = ", ".join("bool_or({0} IS NULL OR {0} NOT IN ({1})) AS f{2}".format(r.level, ", ".join(f"'{x}'" for x in r.species_levels), i)
                      for i, r in enumerate(T.RULES))
    swap = lambda i: f"b.species IS NOT NULL AND f{i}"
    both = ", ".join(
        [f"CASE WHEN {swap(i)} THEN b.{t} ELSE a.{t} END AS {t}" for i, r in enumerate(T.RULES) for t in r.traits]
        + [f"{r.level}, CASE WHEN {swap(i)} THEN 'B' ELSE {r.reference} END AS {r.reference}" for i, r in enumerate(T.RULES)]
        + [f"b.{t}, CASE WHEN b.species IS NOT NULL THEN 'B' END AS {ref}" for t, ref in T.SECOND_ONLY.items()])
    alone = ", ".join([t for r in T.RULES for t in r.traits] + [f"NULL AS {r.level}, 'B' AS {r.reference}" for r in T.RULES]
                      + [f"{t}, 'B' AS {ref}" for t, ref in T.SECOND_ONLY.items()])
    return f"""a AS (SELECT l_partkey AS species, l_returnflag AS area, {", ".join(f"{e} AS {c}" for c, e in {**_A_TRAITS, **_A_LEVELS}.items())},
    {", ".join(f"'A' AS {r.reference}" for r in T.RULES)}
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE {_IN_A}) GROUP BY l_partkey, l_returnflag),
b AS (SELECT p_partkey AS species, {", ".join(f"{e} AS {c}" for c, e in _B_TRAITS.items())} FROM part WHERE {_IN_B}),
listed AS (SELECT p_partkey AS species FROM part WHERE p_brand <> 'Brand#1'),
flags AS (SELECT species, {flags} FROM a GROUP BY species),
filled AS (
  SELECT a.species, area, {both} FROM a JOIN flags USING (species) LEFT JOIN b ON a.species = b.species
  WHERE a.species IN (SELECT species FROM listed)
  UNION ALL SELECT species, NULL, {alone} FROM b
  WHERE species IN (SELECT species FROM listed) AND species NOT IN (SELECT species FROM a))"""


SOURCES_SQL = _sources_sql()
TRAIT_COLS = list(_B_TRAITS)


def gap_filled(spark, sf):
    listed = table(spark, sf, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("species"))
    return T.trait_gap_fill(listed, source_a(spark, sf), source_b(spark, sf))


ROUNDED_SQL = ", ".join(f"{r(c)} AS {c}" for c in TRAIT_COLS)


@query("trait_gap_fill", f"WITH {SOURCES_SQL} SELECT * REPLACE ({ROUNDED_SQL}) FROM filled")
def trait_gap_fill(spark, sf):
    return K.across(gap_filled(spark, sf), TRAIT_COLS, rnd)


@query("group_any_flag", f"""WITH {SOURCES_SQL} SELECT a.species, area, f0 AS f_tl, f2 AS f_fec FROM a JOIN flags USING (species)""")
def group_any_flag(spark, sf):
    a = source_a(spark, sf)
    flag = {"f_tl": ("level_tl", ["spe"]), "f_fec": ("level_fecundity", list(T.SPECIES_LEVELS))}
    f = a.groupBy("species").agg(*[
        F.bool_or(~F.coalesce(F.col(c).isin(ok), F.lit(False))).alias(n) for n, (c, ok) in flag.items()])
    return a.select("species", "area").join(f, "species")
