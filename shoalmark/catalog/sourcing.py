"""Queries on sources and sinks. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean_names
from ..session import scratch_path
from ..sources import readers as S
from .base import query, table

SUPPLIER_SQL = """SELECT s_suppkey, s_name, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS s_nationkey,
  CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier"""


def _supplier(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("s_nationkey"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"))


@query("scan_csv", SUPPLIER_SQL)
def scan_csv(spark, sf):
    df, path = _supplier(spark, sf), scratch_path(spark, "scan_csv")
    S.write_csv(df, path)
    return S.read_csv(spark, path, df.schema)


@query("drop_index_col", SUPPLIER_SQL)
def drop_index_col(spark, sf):
    df, path = _supplier(spark, sf), scratch_path(spark, "indexed_csv")
    # an export with a leading row-number column, named as the reader names a blank header
    S.write_csv(df.select(F.col("s_suppkey").alias("_c0"), *df.columns), path)
    return S.read_csv_by_header(spark, path, df.schema)


@query("clean_names", "SELECT c_custkey AS cust_key, c_name AS full_name, c_nationkey AS nation_no, "
                      "c_mktsegment AS nation_no_2 FROM customer")
def clean_names_(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return clean_names(df.toDF("CustKey", "Full name", "Nation.No", " nation no "))


@query("rownames_to_col", "SELECT p_name || ' ' || p_partkey AS species, p_size, p_retailprice FROM part")
def rownames_to_col(spark, sf):
    df = table(spark, sf, "part").select(
        "p_size", "p_retailprice", F.concat_ws(" ", "p_name", "p_partkey").alias("row_label"))
    return S.rownames_to_column(df, "row_label", "species", before="p_size")


@query("scan_grid_long", """SELECT l_orderkey, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(dayofyear(l_shipdate) AS INTEGER) AS day, l_discount AS temp FROM lineitem
WHERE year(l_shipdate) BETWEEN 1997 AND 1999 AND ((dayofyear(l_shipdate) > 91.5 AND dayofyear(l_shipdate) < 183)
  OR dayofyear(l_shipdate) >= 274.5)""")
def scan_grid_long(spark, sf):
    ts = lambda d: F.lit(d).cast("timestamp_ntz")
    grid = (table(spark, sf, "lineitem")
            .where((F.col("l_shipdate") >= ts("1997-01-01")) & (F.col("l_shipdate") < ts("2000-01-01")))
            .select("l_orderkey", F.year("l_shipdate").alias("year"),
                    F.dayofyear("l_shipdate").alias("day"), F.col("l_discount").alias("temp")))
    return S.scan_grid(grid)


@query("scan_reference_tables", """SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
def scan_reference_tables(spark, sf):
    s, n, g = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
            .select("s_suppkey", "n_name", "r_name"))


@query("scan_covariates", "SELECT event_id, user_id, value FROM events WHERE event_type = 'view'")
def scan_covariates(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").select("event_id", "user_id", "value")


@query("sink_csv", """SELECT p_partkey, p_name || ', "' || p_brand || '"' AS label, nullif(p_type, 'PROMO') AS p_type FROM part""")
def sink_csv(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')).alias("label"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("p_type"))
    path = scratch_path(spark, "sink_csv")
    S.write_csv(df, path)
    return S.read_csv(spark, path, df.schema)
