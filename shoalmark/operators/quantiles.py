"""Exact interpolated quantiles without gathering a group in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here a mergeable
sketch of bounded size only proposes where to cut; exact counts between the cuts say which bracket
holds each wanted rank, and histograms narrow it until it holds one value. No values are ordered: the windows
run over the bins of one histogram. The rows themselves are never shuffled as a whole: every pass is a scan
with a map-side aggregate. The result is exact however good the sketch is, and however the values crowd.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

ACCURACY = 10_000
BINS = 1024


def _running_before(df: DataFrame, keys: Sequence[str], order: str, count: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_skip", F.coalesce(F.sum(count).over(before), F.lit(0)))


def _holds_rank(df: DataFrame, count: str) -> DataFrame:
    """Keep the pieces whose run of ranks holds the wanted one, and make the rank relative."""
    rank, skip = F.col("_rank"), F.col("_skip")
    return (df.where((rank >= skip) & (rank < skip + F.col(count)))
            .withColumn("_rank", rank - skip).drop("_skip", count))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = ACCURACY, bins: int = BINS) -> DataFrame:
    """One row per group: keys, n, q (array in the order of ``probs``), linear interpolation.

    ``df`` is read several times; pass a table, or cut the lineage of a costly plan first.
    """
    keys = list(keys)
    # small tables without group columns meet on a count capped at one
    link = keys or ["_one"]

    def linked(d: DataFrame, count: str) -> DataFrame:
        return d if keys else d.withColumn("_one", F.least(F.col(count), F.lit(1)))

    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    eps = 2.0 / accuracy
    cuts = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-eps, eps)})
    # the small tables between the passes are kept, so that every pass reads the rows once
    sketch = cut_lineage(rows.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"), F.count("*").alias("n")))

    # brackets between the cuts, with their exact counts
    cut_rows = (rows.join(sketch.select(*keys, "_cuts"), keys) if keys
                else rows.withColumn("_cuts", sketch.select("_cuts").scalar()))
    above = [(F.col("_v") > F.col("_cuts")[i]).cast("int") for i in range(len(cuts))]
    cut_rows = cut_rows.withColumn("_b", reduce(lambda a, b: a + b, above)).drop("_cuts")
    boxes = _running_before(
        cut_rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"),
                                          F.max("_v").alias("_hi")), keys, "_b", "_c")
    ranks = F.array(*[
        F.struct(F.lit(i).alias("_p"), F.lit(side).alias("_side"),
                 end((F.col("n") - 1) * F.lit(float(p))).cast("long").alias("_rank"))
        for i, p in enumerate(probs) for side, end in ((0, F.floor), (1, F.ceil))])
    wanted = linked(sketch, "n").select(*link, F.inline(ranks))
    wanted = cut_lineage(_holds_rank(linked(boxes, "_c").join(wanted, link), "_c"))

    # histograms with equal-width bins, until a wanted bin holds one value; a bin ends at its own least and greatest value
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    part = F.nanvl((v / 2 - lo / 2) / (hi / 2 - lo / 2), F.lit(0.5))  # halves do not overflow; infinite ends come away first
    step = F.when(v == hi, bins - 1).when(v == lo, 0).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1)))
    hit = None
    while True:
        done = wanted.where("_lo = _hi").select(*keys, "_p", "_side", lo.alias("_v"))
        hit = done if hit is None else hit.unionByName(done)
        wanted = wanted.where("_lo < _hi")
        if wanted.isEmpty():
            break
        spot = [*keys, "_b", "_lo", "_hi"]
        box = wanted.select(*spot).distinct()
        inside = cut_rows.join(box, [*keys, "_b"]).where((v >= lo) & (v <= hi)).withColumn("_bin", step)
        hist = inside.groupBy(*spot, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        found = _holds_rank(_running_before(hist, spot, "_bin", "_c").join(wanted.select(*spot, "_p", "_side", "_rank"), spot), "_c")
        wanted = cut_lineage(found.select(*keys, "_b", "_p", "_side", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi")))

    ends = hit.groupBy(*keys).agg(F.count("*").alias("_hits"), *[
        F.max(F.when((F.col("_p") == i) & (F.col("_side") == s), F.col("_v"))).alias(f"_q{i}_{s}")
        for i in range(len(probs)) for s in (0, 1)])
    out = linked(sketch, "n").join(linked(ends, "_hits"), link)
    q = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        a, b = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        q.append(a + (b - a) * (h - F.floor(h)))
    return out.select(*keys, "n", F.array(*q).alias("q"))


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    rest = df.groupBy(*keys).agg(F.min(value).alias("min"), F.avg(value).alias("mean"),
                                 F.max(value).alias("max"))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    if keys:
        both = rest.join(q, list(keys))
    else:
        both = rest.withColumns({c: q.select(c).scalar() for c in ("q1", "median", "q3")})
    return both.select(*keys, "min", "q1", "median", "mean", "q3", "max")


def median_interval(draws: DataFrame, keys: Sequence[str], value: str, width: float = 0.95) -> DataFrame:
    """Median and central interval of posterior draws per parameter."""
    tail = (1 - width) / 2
    q = exact_quantiles(draws, keys, value, [tail, 0.5, 1 - tail])
    return q.select(*keys, F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("upper"))
