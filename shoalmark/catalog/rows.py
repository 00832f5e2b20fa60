"""Queries on projections, filters, scalar functions, orderings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K, nulls as N
from ..operators import ordering as O, sets as U
from .base import query, r, rnd, table


def _day(c):
    return F.dayofyear(c)


# ---- projections and filters ----------------------------------------------------------------

@query("select_range", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def select_range(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", *K.column_range(df, "p_brand", "p_size"))


@query("select_except", "SELECT * EXCLUDE (o_custkey, o_orderpriority) FROM orders")
def select_except(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(*K.columns_except(df, ["o_custkey", "o_orderpriority"]))


@query("select_by_type", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_by_type(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*K.columns_of_type(df))


@query("rename_cols", "SELECT s_suppkey AS tow, s_name AS station, s_nationkey AS id, s_acctbal "
                      "FROM supplier")
def rename_cols(spark, sf):
    return table(spark, sf, "supplier").withColumnsRenamed(
        {"s_suppkey": "tow", "s_name": "station", "s_nationkey": "id"})


@query("relocate_cols", "SELECT p_partkey, p_size, p_retailprice, p_name, p_brand, p_type FROM part")
def relocate_cols(spark, sf):
    return K.relocate(table(spark, sf, "part"), ["p_size", "p_retailprice"], before="p_name")


@query("filter_compare", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 250000 AND o_orderdate < TIMESTAMP '2000-01-01'""")
def filter_compare(spark, sf):
    return (table(spark, sf, "orders")
            .where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 250000)
                   & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")))
            .select("o_orderkey", "o_totalprice"))


@query("filter_day_window", """SELECT l_orderkey, l_partkey, CAST(dayofyear(l_shipdate) AS INTEGER) AS day
FROM lineitem WHERE (dayofyear(l_shipdate) > 91.5 AND dayofyear(l_shipdate) < 183)
   OR dayofyear(l_shipdate) >= 274.5""")
def filter_day_window(spark, sf):
    return (table(spark, sf, "lineitem")
            .select("l_orderkey", "l_partkey", _day("l_shipdate").alias("day"))
            .where(K.survey_days("day")))


@query("filter_in_list", """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O')""")
def filter_in_list(spark, sf):
    return (table(spark, sf, "orders")
            .where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
                   & F.col("o_orderstatus").isin("F", "O"))
            .select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query("filter_not_in_list", """SELECT p_partkey, p_brand FROM (
  SELECT p_partkey, nullif(p_brand, 'Brand#5') AS p_brand FROM part)
WHERE p_brand IS NULL OR p_brand NOT IN ('Brand#1', 'Brand#2')""")
def filter_not_in_list(spark, sf):
    return (table(spark, sf, "part")
            .select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("p_brand"))
            .where(N.not_in("p_brand", ["Brand#1", "Brand#2"])))


HOLES_SQL = """holes AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price FROM orders)"""


def _holes(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"))


@query("drop_na_any", f"WITH {HOLES_SQL} SELECT * FROM holes WHERE status IS NOT NULL AND price IS NOT NULL")
def drop_na_any(spark, sf):
    return N.drop_na_any(_holes(spark, sf), "status", "price")


@query("drop_na_all", f"WITH {HOLES_SQL} SELECT * FROM holes WHERE status IS NOT NULL OR price IS NOT NULL")
def drop_na_all(spark, sf):
    return N.drop_na_all(_holes(spark, sf), "status", "price")


@query("filter_is_null", f"WITH {HOLES_SQL} SELECT o_orderkey, price FROM holes WHERE status IS NULL")
def filter_is_null(spark, sf):
    return _holes(spark, sf).where(F.col("status").isNull()).select("o_orderkey", "price")


@query("filter_scalar_agg", """SELECT o_orderkey, o_orderdate FROM orders
WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)""")
def filter_scalar_agg(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    first = df.agg(F.year(F.min("o_orderdate")).alias("y")).scalar()
    return df.where(F.year("o_orderdate") == first)


@query("recode_case", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'THRIFT'
  WHEN 'PROMO' THEN 'PROMOTION' ELSE p_type END AS p_type FROM part""")
def recode_case(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", K.recode("p_type", {"ECONOMY": "THRIFT", "PROMO": "PROMOTION"}).alias("p_type"))


@query("season_from_day", """SELECT o_orderkey, CASE WHEN dayofyear(o_orderdate) < 183 THEN 'spring'
  WHEN dayofyear(o_orderdate) >= 274.5 THEN 'fall' END AS season FROM orders""")
def season_from_day(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", K.season_from_day(_day("o_orderdate")).alias("season"))


@query("decade_bucket", """SELECT o_orderkey, CASE WHEN y < 1980 THEN '1970-1979'
  WHEN y < 1990 THEN '1980-1989' WHEN y < 2000 THEN '1990-1999' WHEN y < 2010 THEN '2000-2009'
  ELSE '2010-2019' END AS decade
FROM (SELECT o_orderkey, 1970 + 9 * (year(o_orderdate) - 1995) AS y FROM orders)""")
def decade_bucket(spark, sf):
    # seven order years spread over the range of the bins
    year = 1970 + 9 * (F.year("o_orderdate") - 1995)
    return table(spark, sf, "orders").select("o_orderkey", K.decade(year).alias("decade"))


@query("replace_null", f"""WITH {HOLES_SQL}
SELECT o_orderkey, coalesce(status, 'unknown') AS status, price FROM holes""")
def replace_null(spark, sf):
    return _holes(spark, sf).fillna({"status": "unknown"})


@query("nan_to_null", """SELECT p_partkey, CAST(nullif(p_size, 9) AS DOUBLE) AS size_x,
  CASE WHEN p_retailprice >= 905 THEN p_retailprice END AS price_x FROM part""")
def nan_to_null(spark, sf):
    nan = F.lit(float("nan"))
    df = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") == 9, nan).otherwise(F.col("p_size").cast("double")).alias("size_x"),
        F.when(F.col("p_retailprice") < 905, nan).otherwise(F.col("p_retailprice")).alias("price_x"))
    return N.nan_to_null(df)


TWO_SQL = """two AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS a,
  CASE WHEN p_size < 40 THEN p_retailprice END AS b FROM part)"""


def _two(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("a"),
        F.when(F.col("p_size") < 40, F.col("p_retailprice")).alias("b"))


@query("coalesce_pref", f"WITH {TWO_SQL} SELECT p_partkey, coalesce(a, b) AS x FROM two")
def coalesce_pref(spark, sf):
    return _two(spark, sf).select("p_partkey", F.coalesce("a", "b").alias("x"))


@query("midpoint", f"""WITH {TWO_SQL} SELECT p_partkey, {r('CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END')} AS mid
FROM two""")
def midpoint(spark, sf):
    return _two(spark, sf).select("p_partkey", rnd(K.midpoint("a", "b")).alias("mid"))


@query("across_transform", f"""SELECT o_orderkey, {r('ln(o_totalprice)')} AS o_totalprice FROM orders""")
def across_transform(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return K.across(df, K.columns_of_type(df), lambda c: rnd(N.ln0(c)))


@query("add_const_null_cols", """SELECT n_nationkey, n_name, CAST(NULL AS DOUBLE) AS temperature,
  CAST(NULL AS VARCHAR) AS reference, 'survey' AS source FROM nation
UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name, NULL, NULL, 'survey' FROM supplier""")
def add_const_null_cols(spark, sf):
    a = table(spark, sf, "nation").select("n_nationkey", "n_name")
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return K.add_null_columns(a.union(b), {"temperature": "double", "reference": "string"}
                              ).withColumn("source", F.lit("survey"))


@query("as_factor", """SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT)
  AS p_brand_code FROM part""")
def as_factor(spark, sf):
    return O.as_factor(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@query("with_derived_ratio", f"""SELECT o_orderkey, {r('o_totalprice / nullif(d - 100, 0)')} AS cv_temp,
  {r('CASE WHEN d > 50 THEN ln(d - 50) END')} AS log_landings
FROM (SELECT o_orderkey, o_totalprice, dayofyear(o_orderdate) AS d FROM orders)""")
def with_derived_ratio(spark, sf):
    d = _day("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", rnd(N.ratio(F.col("o_totalprice"), d - 100)).alias("cv_temp"),
        rnd(N.ln0(d - 50)).alias("log_landings"))


# ---- scalar functions -----------------------------------------------------------------------

@query("sentence_case", """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label
FROM customer""")
def sentence_case(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", K.sentence_case("c_mktsegment").alias("label"))


@query("case_fold", "SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS hi FROM customer")
def case_fold(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("lo"), F.upper("c_name").alias("hi"))


@query("paste_key", f"""WITH {HOLES_SQL} SELECT o_orderkey,
  coalesce(CAST(o_orderkey AS VARCHAR), 'NA') || '-' || coalesce(status, 'NA') AS ts_id FROM holes""")
def paste_key(spark, sf):
    return _holes(spark, sf).select("o_orderkey", N.paste("o_orderkey", "status", sep="-").alias("ts_id"))


@query("split_first_word", """SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS taxa,
  nullif(split_part(p_name, ' ', 2), '') AS junk, nullif(split_part(p_name, ' ', 3), '') AS third FROM part""")
def split_first_word(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_name", K.word("p_name", 0).alias("taxa"), K.word("p_name", 1).alias("junk"),
        K.word("p_name", 2).alias("third"))


@query("split_time_label", """SELECT event_id, CAST(strftime(ts, '%j') AS DOUBLE) AS time_point FROM events""")
def split_time_label(spark, sf):
    label = F.concat_ws("_", F.col("event_type"), F.date_format("ts", "DDD"))
    return (table(spark, sf, "events").select("event_id", label.alias("time"))
            .select("event_id", K.word("time", 1, "_").try_cast("double").alias("time_point")))


@query("zero_pad", """SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 3
  THEN CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END AS station FROM supplier""")
def zero_pad(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", K.zero_pad("s_suppkey").alias("station"))


@query("exp_log", f"""SELECT l_orderkey, l_linenumber, {r('exp(l_discount)')} AS e, {r('ln(l_quantity)')} AS l,
  {r('exp(ln(l_extendedprice))', 4)} AS back FROM lineitem""")
def exp_log(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rnd(F.exp("l_discount")).alias("e"),
        rnd(N.ln0("l_quantity")).alias("l"),
        rnd(F.exp(N.ln0("l_extendedprice")), 4).alias("back"))


@query("arith_unit", f"""SELECT vec_id, {r('CAST(embedding[1] AS DOUBLE) * 1000')} AS x_m,
  {r('CAST(embedding[2] AS DOUBLE) * 1000')} AS y_m FROM embeddings""")
def arith_unit(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", rnd(F.get(e, F.lit(0)).cast("double") * 1000).alias("x_m"),
        rnd(F.get(e, F.lit(1)).cast("double") * 1000).alias("y_m"))


@query("poly_terms", f"""SELECT o_orderkey, {r('z')} AS z1, {r('z * z')} AS z2 FROM (
  SELECT o_orderkey, ln(o_totalprice) - (SELECT avg(ln(o_totalprice)) FROM orders) AS z FROM orders)""")
def poly_terms(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", N.ln0("o_totalprice").alias("x"))
    z = F.col("x") - df.agg(F.avg("x").alias("m")).scalar()
    return df.select("o_orderkey", rnd(z).alias("z1"), rnd(z * z).alias("z2"))


@query("seq_grid", f"""SELECT CAST(i AS INTEGER) AS step, {r('lo + (hi - lo) * i / 99e0')} AS depth, {r('m')} AS bt_seasonal
FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(dayofyear(o_orderdate)) AS m FROM orders),
     range(0, 100) t(i)""")
def seq_grid(spark, sf):
    one = table(spark, sf, "orders").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.avg(_day("o_orderdate")).alias("m"))
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("step"))
    return grid.select("step", rnd(F.expr("lo + (hi - lo) * step / 99D")).alias("depth"),
                       rnd("m").alias("bt_seasonal"))


@query("normal_ci", f"""SELECT o_custkey, {r('m')} AS est, {r('m - 1.96e0 * s / sqrt(n)')} AS lwr,
  {r('m + 1.96e0 * s / sqrt(n)')} AS upr
FROM (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n
      FROM orders GROUP BY o_custkey)""")
def normal_ci(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("est"), F.stddev_samp("o_totalprice").alias("s"),
        F.count("*").alias("n"))
    half = 1.96 * F.col("s") / F.sqrt("n")
    return g.select("o_custkey", rnd("est").alias("est"), rnd(F.col("est") - half).alias("lwr"),
                    rnd(F.col("est") + half).alias("upr"))


# ---- orderings ------------------------------------------------------------------------------

@query("sort_multi", f"""WITH {HOLES_SQL} SELECT *, row_number() OVER (ORDER BY status ASC NULLS LAST,
  price ASC NULLS LAST, o_orderkey) AS pos FROM holes""")
def sort_multi(spark, sf):
    return O.with_row_id(_holes(spark, sf), O.nulls_last("status", "price", "o_orderkey"), "pos")


@query("sort_desc", f"""WITH {HOLES_SQL} SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST,
  o_orderkey) AS pos FROM holes""")
def sort_desc(spark, sf):
    return O.with_row_id(_holes(spark, sf), O.nulls_last("price", "o_orderkey", desc=["price"]), "pos")


@query("order_groups_by_mean", f"""SELECT event_type, {r('mean_value')} AS mean_value,
  row_number() OVER (ORDER BY mean_value, event_type) AS facet
FROM (SELECT event_type, avg(value) AS mean_value FROM events GROUP BY event_type)""")
def order_groups_by_mean(spark, sf):
    return (O.order_groups_by_mean(table(spark, sf, "events"), "event_type", "value", "facet")
            .withColumn("mean_value", rnd("mean_value")))


@query("head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def head_n(spark, sf):
    return (table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6))


@query("sort_vector", """SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS pos
FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def sort_vector(spark, sf):
    return O.with_row_id(table(spark, sf, "customer").select("c_mktsegment").distinct(),
                         ["c_mktsegment"], "pos")


@query("row_id", """SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) AS tow_id FROM (
  SELECT DISTINCT 40 + 10 * CAST(embedding[2] AS DOUBLE) AS lat, -70 + 10 * CAST(embedding[1] AS DOUBLE) AS lon
  FROM embeddings)""")
def row_id(spark, sf):
    e = F.col("embedding")
    pos = table(spark, sf, "embeddings").select(
        (40 + 10 * F.get(e, F.lit(1)).cast("double")).alias("lat"),
        (-70 + 10 * F.get(e, F.lit(0)).cast("double")).alias("lon")).distinct()
    return O.with_row_id(pos, ["lat", "lon"], "tow_id")


@query("first_per_key", """SELECT p_brand, p_type, p_name, p_partkey FROM (SELECT *,
  row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name, p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_per_key(spark, sf):
    df = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_partkey")
    return O.first_per_key(df, ["p_brand", "p_type"], ["p_name", "p_partkey"])


# ---- sets -----------------------------------------------------------------------------------

@query("union_by_name", """SELECT s_nationkey AS nation, s_acctbal AS bal, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"),
        F.col("c_nationkey").alias("nation"))
    return U.bind_rows(s, c)


@query("union_list", """SELECT 'supplier' AS kind, s_nationkey AS nation FROM supplier
UNION ALL SELECT 'customer', c_nationkey FROM customer UNION ALL SELECT 'nation', n_nationkey FROM nation""")
def union_list(spark, sf):
    named = {"supplier": "s_nationkey", "customer": "c_nationkey", "nation": "n_nationkey"}
    return U.bind_list(table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(c).alias("nation"))
                       for t, c in named.items())


KEYS_SQL = "a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT DISTINCT o_custkey AS k FROM orders)"


def _keys(spark, sf):
    """Codes used by catches and by orders; the two ranges overlap in part."""
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return a, b


@query("intersect_keys", f"WITH {KEYS_SQL} SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect_keys(spark, sf):
    return U.keys_in_both(*_keys(spark, sf))


@query("except_keys", f"WITH {KEYS_SQL} SELECT k FROM a EXCEPT SELECT k FROM b")
def except_keys(spark, sf):
    return U.keys_only_in_first(*_keys(spark, sf))


@query("union_distinct_keys", f"WITH {KEYS_SQL} SELECT k FROM a UNION SELECT k FROM b")
def union_distinct_keys(spark, sf):
    return U.keys_in_either(*_keys(spark, sf))
