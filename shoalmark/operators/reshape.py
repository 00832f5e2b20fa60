"""Wide and long forms, and complete panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, written

# Copies of the levels that the rows are dealt over.
SALTS = 32


def replicate(df: DataFrame, levels: DataFrame, salts: int = SALTS) -> DataFrame:
    """Repeat every row of ``df`` once per row of ``levels``.

    One equi-join for every size: rows are dealt over salts by their place in the partition, so equal rows
    spread as well, and every salt has all levels. The salted levels are written, so that whether they are broadcast is
    decided on their size.
    """
    dealt = written(levels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "levels")
    left = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return left.join(dealt, "_salt").drop("_salt")


def _declared(names: str, levels: Sequence) -> Column:
    """The level column; a value outside the declared list is an error instead of vanishing from the wide form."""
    c = F.col(names)
    told = F.concat(F.lit(f"{names}: not among the declared levels: "), c.cast("string"))
    return F.when(c.isNull() | c.isin(list(levels)), c).otherwise(F.raise_error(told)).alias(names)


def _checked(df: DataFrame, names: str, levels: Sequence) -> DataFrame:
    return df.withColumn(names, _declared(names, levels))


def complete_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All combinations of the observed values; unseen combinations get NULL measures."""
    seen = cut_lineage(df.select(*cols).distinct())
    grid = seen.select(cols[0]).distinct()
    for c in cols[1:]:
        grid = replicate(grid, seen.select(c).distinct())
    there = df.withColumnsRenamed({c: f"_k_{c}" for c in cols})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cols])
    return grid.join(there, same, "left").drop(*[f"_k_{c}" for c in cols])


def pivot_fill0(df: DataFrame, site_cols: Sequence[str], names: str, values: str,
                levels: Sequence) -> DataFrame:
    """Wide matrix in sorted column order; absent cells are 0, recorded missing values stay NULL."""
    levels = sorted(levels)
    wide = (_checked(df, names, levels).groupBy(*site_cols).pivot(names, levels)
            .agg(F.max(values).alias("v"), F.count(F.lit(1)).alias("n")))
    return wide.select(*site_cols, *[
        F.when(F.coalesce(F.col(f"`{x}_n`"), F.lit(0)) == 0, F.lit(0.0))
        .otherwise(F.col(f"`{x}_v`")).alias(str(x)) for x in levels])


def pivot_values(df: DataFrame, id_cols: Sequence[str], names: str, values: Sequence[str],
                 levels: Sequence, agg=F.first) -> DataFrame:
    """Wide form of one or several value columns; several give ``value_level`` names."""
    df = _checked(df, names, levels)
    if len(values) == 1:
        return df.groupBy(*id_cols).pivot(names, list(levels)).agg(agg(values[0]))
    wide = df.groupBy(*id_cols).pivot(names, list(levels)).agg(*[agg(v).alias(v) for v in values])
    return wide.select(*id_cols, *[F.col(f"`{x}_{v}`").alias(f"{v}_{x}")
                                   for v in values for x in levels])


def pivot_mean_fill(df: DataFrame, row: str, names: str, value: str, levels: Sequence,
                    fill: Column | None = None) -> DataFrame:
    """Year x region matrix; absent cells take ``fill`` (default: the mean of all rows)."""
    fill = df.agg(F.avg(value).alias("m")).scalar() if fill is None else fill
    wide = _checked(df, names, levels).groupBy(row).pivot(names, list(levels)).agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    return wide.select(row, *[
        F.when(F.coalesce(F.col(f"`{x}_n`"), F.lit(0)) == 0, fill)
        .otherwise(F.col(f"`{x}_v`")).alias(str(x)) for x in levels])


def pivot_longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)
