"""URL filters by hashed expressions, in DataFrame functions alone.

A rule is a host and a path: it fits its host and all subdomains where the URL's path starts with the rule's. Every
URL is expanded into its host suffixes and those path prefixes whose length some rule has. Expressions meet the rules
in an equi-join on a short prefix of their SHA-256 digest, the full digests are compared afterwards, and the rule
with the longest host and path wins (then the longer host, then block before allow, then the smaller text).

Each row keeps its identity through a number given on reading, so the best rule of a row is one plain aggregate that
is complete within its task: hot hosts never meet. A short rule list is broadcast on its known size; a long one is
shuffled, with skewed expressions split by adaptive execution.

Rows: a null URL or one without "://" has empty host and path, fits no rule and gets the verdict of the method.
Every row, repeated or not, gives one row; nulls elsewhere do not matter. Rules with a null or empty host, null path or
unknown verdict are ignored. An empty rule list gives every row the method's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read
from .registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join compares.
SHORT = 8


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict; ``rules`` has host, path and verdict."""
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("_rhost"), F.col("path").alias("_rpath"),
                          F.col("verdict").alias("_verdict"))
             .where("_rhost <> '' AND _rpath IS NOT NULL AND _verdict IN ('allow', 'block')").distinct())
    # distinct lengths of paths: at most as many as the longest path has characters
    lengths = sorted(r[0] for r in rules.select(F.length("_rpath")).distinct().collect())
    digest = F.sha2(F.concat("_rhost", F.lit("\n"), "_rpath"), 256)
    hashed = (rules.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, SHORT))
              .withColumn("_order", F.struct(F.length("_rhost") + F.length("_rpath"), F.length("_rhost"),
                                             F.when(F.col("_verdict") == "block", 1).otherwise(0))))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # parsing ends here: the number is not deterministic for the optimizer, which so keeps the parts computed once
    rows = (pages.select(F.struct(*kept).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
            .withColumn("_id", F.monotonically_increasing_id()))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]) if lengths else F.expr("CAST(array() AS array<int>)"),
                                    lambda n: F.when(F.length("_path") >= n, F.substring(F.col("_path"), F.lit(1), n))),
                        lambda p: p.isNotNull())
    found = (rows.withColumn("_suffix", F.explode(suffixes))
             .withColumn("_prefix", F.explode_outer(prefixes))
             .withColumn("_digest_url", F.sha2(F.concat("_suffix", F.lit("\n"), "_prefix"), 256))
             .withColumn("_short_url", F.substring("_digest_url", 1, SHORT))
             .join(hashed, F.col("_short_url") == F.col("_short"), "left"))
    best = F.struct(F.col("_order"), F.col("_rhost"), F.col("_rpath"), F.col("_verdict"))
    judged = found.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_host").alias("host"),
                                      F.first("_path").alias("path"),
                                      F.max(F.when(F.col("_digest") == F.col("_digest_url"), best)).alias("_best"))  # the full digest confirms
    return judged.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "host", "path",
                         F.concat("_best._rhost", "_best._rpath").alias("rule"),
                         F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))


#: The rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SQL = """
WITH cut AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ranked AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM parts p LEFT JOIN rules
    ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""


@query("op5_url_filters", SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")
