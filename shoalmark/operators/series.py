"""Yearly series: positions, lags, autocorrelation, recursion, smoothing and trends.

No series has to fit in one task. A window runs over a series only after the longest one was counted and is short;
otherwise neighbours meet by their positions, which come from a distributed numbering, recursions are folded in
blocks whose affine maps are chained, and moving means send each value to the steps that use it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import _c, require_unique
from ..session import cut_lineage
from .ordering import with_row_id

#: Longest series that a window may order in one task.
LONGEST_WINDOW = 100_000
#: Steps that are folded in one row.
BLOCK = 256


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Position 1..n of each row within its series, without a per-series task.

    All rows are numbered in one range-sorted pass; a series starts at the smallest of its numbers.
    """
    ids = with_row_id(df, [*keys, *order], "_id")
    start = ids.groupBy(*keys).agg((F.min("_id") - 1).alias("_start"))
    return ids.join(start, list(keys)).withColumn(name, F.col("_id") - F.col("_start")).drop("_id", "_start")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                    max_lag: int | None = None) -> DataFrame:
    """Autocorrelation of the positional series at lags 0 .. floor(10 log10 n).

    Each value is sent to the positions it is compared with, so the work is spread by
    (series, position) and a long series does not land in one task.
    """
    keys = list(keys)
    pos = cut_lineage(positions(df.select(*keys, *order, F.col(value).cast("double").alias("_x")),
                                keys, order).select(*keys, "pos", "_x"))
    stats = pos.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"))
    top = F.floor(10 * F.log10("_n")).cast("int") if max_lag is None else F.lit(max_lag)
    dev = (pos.join(stats, keys)
           .select(*keys, "pos", "_n", (F.col("_x") - F.col("_m")).alias("_d"),
                   F.least(top, (F.col("_n") - 1).cast("int")).alias("_top")))
    sent = (dev.select(*keys, "_n", F.col("pos").alias("_at"), F.col("_d").alias("_a"),
                       F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("lag"))
            .withColumn("pos", F.col("_at") + F.col("lag")))
    met = sent.join(dev.select(*keys, "pos", F.col("_d").alias("_b")), [*keys, "pos"])
    prod = met.groupBy(*keys, "lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))
    var = dev.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"))
    return prod.join(var, keys).select(*keys, "lag", F.try_divide("_s", "_v").alias("acf"))


def previous(df: DataFrame, series: Sequence[str], time: str, cols: Sequence[str],
             checked: bool = False, longest: int = LONGEST_WINDOW) -> DataFrame:
    """Previous value of each column within its series, and the gap in time to it.

    If a series has more than ``longest`` rows, each row meets its neighbour in a join on the position before it, which
    spreads a single long series over all tasks; the longest series is counted first.
    """
    if not checked:
        df = require_unique(df, *series, time)
    sizes = df.groupBy(*series).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()
    if (sizes[0] or 0) <= longest:
        w = Window.partitionBy(*series).orderBy(time)
        return df.withColumns({**{f"prev_{c}": F.lag(c).over(w) for c in cols},
                               "gap": F.col(time) - F.lag(time).over(w)})
    numbered = cut_lineage(with_row_id(df, [*series, time], "_id"))
    before = numbered.select((F.col("_id") + 1).alias("_id"), F.struct(*series).alias("_series"), F.col(time).alias("_time"),
                             *[F.col(c).alias(f"prev_{c}") for c in cols])
    same = F.struct(*series).eqNullSafe(F.col("_series"))
    out = numbered.join(before, "_id", "left")
    return out.select(*df.columns, *[F.when(same, F.col(f"prev_{c}")).alias(f"prev_{c}") for c in cols],
                      F.when(same, F.col(time) - F.col("_time")).alias("gap"))


def affine_scan(rows: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """States of x_t = a_t x_(t-1) + b_t: ``rows(keys, pos, a, b)`` with positions 1..n to (keys, pos, x).

    Blocks of steps are folded to one affine map each; the maps form a recursion of their own that is shorter by the size of a
    block, so a series of n steps takes log(n) / log(block) levels and linear work, and no row or task holds more than a
    block. A series starts from x_0 = 0, so its first b is its first state.
    """
    keys = list(keys)
    longest = rows.agg(F.max("pos")).first()[0] or 0
    at = ((F.col("pos") - 1) / block).cast("long")
    blocks = rows.groupBy(*keys, at.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("_s"))
    start = F.lit(0.0)
    if longest > block:
        blocks = cut_lineage(blocks)
        maps = blocks.select(
            *keys, (F.col("_block") + 1).alias("pos"),
            F.aggregate("_s", F.lit(1.0), lambda x, s: x * s["a"]).alias("a"),
            F.aggregate("_s", F.lit(0.0), lambda x, s: s["a"] * x + s["b"]).alias("b"))
        ends = affine_scan(maps, keys, block).select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("pos").alias("_next"), F.col("x").alias("_x0"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        blocks = (blocks.join(ends, reduce(lambda a, b: a & b, same, F.col("_block") == F.col("_next")), "left")
                  .drop("_next", *[f"_k_{k}" for k in keys]))
        # a block after an unknown state is unknown; the first block has none before it
        start = F.when(F.col("_block") == 0, F.lit(0.0)).otherwise(F.col("_x0"))
    states = F.aggregate("_s", F.array().cast("array<double>"), lambda acc, s: F.array_append(
        acc, s["a"] * F.when(F.size(acc) == 0, start).otherwise(F.element_at(acc, -1)) + s["b"]))
    pairs = F.arrays_zip(F.transform("_s", lambda s: s["pos"]).alias("pos"), states.alias("x"))
    return blocks.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.pos", "_p.x")


def ar1_recursion(df: DataFrame, region: str, year: str, mean: str, start: str, phi: float | Column,
                  name: str = "x_hat", block: int = BLOCK) -> DataFrame:
    """x_1 = start of the region, then x_t = phi x_(t-1) + mean_t, years in order per region.

    The years of a region must be unique; a region may have any number of them (:func:`affine_scan`).
    """
    df = require_unique(df, region, year)
    phi = F.lit(phi) if isinstance(phi, (int, float)) else phi
    rows = positions(df.select(region, year, F.col(mean).cast("double").alias("_m"), F.col(start).cast("double").alias("_x0"),
                               phi.cast("double").alias("_phi")), [region], [year])
    first = F.col("pos") == 1
    steps = cut_lineage(rows.select(region, year, "pos", F.when(first, F.lit(0.0)).otherwise(F.col("_phi")).alias("a"),
                                    F.when(first, F.col("_x0")).otherwise(F.col("_m")).alias("b")))
    states = affine_scan(steps.select(region, "pos", "a", "b"), [region], block)
    return (steps.select(region, year, "pos").join(states, [region, "pos"])
            .select(region, year, F.col("x").alias(name)))


def rolling_mean(df: DataFrame, group: Sequence[str], time: str, value: str, half: int = 2,
                 name: str = "trend") -> DataFrame:
    """Centred moving mean over ``half`` time steps on each side, per group; time is a whole number.

    The sum of each step is sent to the steps that use it and added up there, so the work is spread by (group, step).
    """
    group = list(group)
    per = df.groupBy(*group, time).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.lit(True).alias("_own"))
    shift = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    sent = per.select(*group, time, "_s", "_n", shift.alias("_by")).select(
        *group, (F.col(time) + F.col("_by")).cast(per.schema[time].dataType).alias(time), "_s", "_n", (F.col("_by") == 0).alias("_own"))
    got = sent.groupBy(*group, time).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.bool_or("_own").alias("_own"))
    return got.where("_own").select(*group, time, F.try_divide("_s", "_n").alias(name))


def trend_per_group(df: DataFrame, group: Sequence[str], time: str, value: str) -> DataFrame:
    """Straight line per group."""
    y, t = _c(value).cast("double"), _c(time).cast("double")
    return df.groupBy(*group).agg(
        F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"),
        F.regr_r2(y, t).alias("r2"), F.regr_count(y, t).alias("n"))


def gaussian_aic(n: Column, rss: Column, n_coef: int) -> Column:
    """AIC of a least-squares fit; the error variance counts as one more parameter."""
    two_pi = 6.283185307179586
    return n * F.ln(F.lit(two_pi) * rss / n) + n + 2 * (n_coef + 1)
