"""Summaries that are one aggregate, or a scalar subquery where a global figure is needed."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import EXTENT_PAD
from ..functions.nulls import mean_na


def mean_across(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean_na(c).alias(c) for c in cols])


def mean_sd(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def count_having(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
            .orderBy(F.desc("n"), *keys))


def count_distinct(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Number of different values, counting a missing value as one."""
    return (df.select(*keys, col).distinct().groupBy(*keys).agg(F.count("*").alias("n_distinct")))


def pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All correlations in one pass; each pair uses the rows where both are present."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between the smallest and largest value, the largest in the last bin.

    A constant column has all its rows in the first bin; missing values and NaN are not counted.
    """
    v = df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    box = v.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    b = F.width_bucket("_v", box.select("lo").scalar(), box.select("hi").scalar(), F.lit(bins))
    return v.groupBy(F.least(F.coalesce(b, F.lit(1)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sample sd over all rows; the figures arrive as scalar subqueries."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}")
                     for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    return df.withColumns({
        c: F.try_divide(F.col(c).cast("double") - stats.select(f"m_{c}").scalar(),
                        stats.select(f"s_{c}").scalar()) for c in cols})


def extent_bbox(df: DataFrame, lon: str, lat: str, pad=EXTENT_PAD) -> DataFrame:
    w, s, e, n = pad
    return df.agg((F.min(lon) + w).alias("xmin"), (F.min(lat) + s).alias("ymin"),
                  (F.max(lon) + e).alias("xmax"), (F.max(lat) + n).alias("ymax"))


NUMBERS = ("double", "float", "integer", "long", "short", "byte")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, different values, range.

    Two scans for any number of columns. The first aggregates rows, missing values and ranges of all columns; the second stacks
    (column, value) with one value field per type, so that values are compared in their own type, and reduces them to
    different ones within each task before the shuffle.
    """
    fields = [(i, f.dataType.simpleString(), f.dataType.typeName() in NUMBERS, F.col(f"`{f.name}`")) for i, f in enumerate(df.schema)]
    sums = [F.count("*").alias("n")]
    for i, _, number, c in fields:
        sums += [F.count(c).alias(f"c{i}"), F.min(c).cast("double" if number else "string").alias(f"l{i}"), F.max(c).cast("double" if number else "string").alias(f"h{i}")]
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    per = F.array(*[F.struct(
        F.lit(i).alias("_i"), F.lit(df.columns[i]).alias("column"), F.lit(kind).alias("type"), F.col("n"), (F.col("n") - F.col(f"c{i}")).alias("n_null"),
        *[(F.col(f"{k}{i}") if number else no_number).alias(f"{name}_number") for k, name in (("l", "min"), ("h", "max"))],
        *[(no_text if number else F.col(f"{k}{i}")).alias(f"{name}_text") for k, name in (("l", "min"), ("h", "max"))]) for i, kind, number, _ in fields])
    one = df.agg(*sums).select(F.inline(per))

    kinds = list(dict.fromkeys(kind for _, kind, _, _ in fields))
    stacked = F.array(*[F.struct(F.lit(i).alias("_c"), *[(c if kind == k else F.lit(None).cast(k)).alias(f"_v{j}") for j, k in enumerate(kinds)])
                        for i, kind, _, c in fields])
    values = [f"_v{j}" for j in range(len(kinds))]
    different = (df.select(F.inline(stacked)).where(" OR ".join(f"{v} IS NOT NULL" for v in values)).groupBy("_c", *values).agg(F.lit(1).alias("_one"))
                 .groupBy("_c").agg(F.count("*").alias("n_distinct")))
    return (one.join(different, F.col("_i") == F.col("_c"), "left")
            .select("column", "type", "n", "n_null", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"),
                    "min_number", "max_number", "min_text", "max_text"))
