"""Orderings, numbering and level codes that never gather all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import _c
from ..session import cut_lineage

_LOCAL = (1 << 33) - 1


def with_row_id(df: DataFrame, order: Sequence[Column | str], name: str = "row_id",
                start: int = 1) -> DataFrame:
    """Number all rows 1..n in a total order.

    A range sort spreads the rows, each partition counts its own, and only the partition sizes
    (one row per partition) are summed up in order. The sorted rows are checkpointed so that both
    readers see the same partitions. ``order`` must be total for the numbers to be repeatable.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip")))
    # one row per partition, so the broadcast is bounded by the partition count
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_skip") + F.col("_at").bitwiseAND(F.lit(_LOCAL)) + F.lit(start))
            .drop("_part", "_at", "_skip"))


def nulls_last(*cols: str, desc: Sequence[str] = ()) -> list[Column]:
    return [F.desc_nulls_last(c) if c in desc else F.asc_nulls_last(c) for c in cols]


def factor_levels(df: DataFrame, col: str, start: int = 0) -> DataFrame:
    """Sorted levels of a column with their integer codes."""
    return with_row_id(df.select(col).where(F.col(col).isNotNull()).distinct(), [col],
                       f"{col}_code", start)


def as_factor(df: DataFrame, col: str) -> DataFrame:
    return df.join(factor_levels(df, col), col, "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; a plain aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[_c(c) for c in order])).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def order_groups_by_mean(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Rank of each group by its mean value."""
    means = df.groupBy(group).agg(F.avg(value).alias("mean_value"))
    return with_row_id(means, ["mean_value", group], name)
