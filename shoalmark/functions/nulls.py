"""Missing-value rules of the analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    c = _c(c)
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def sum0(c: Column | str) -> Column:
    """Sum that skips NULL and is 0 when nothing is left."""
    return F.coalesce(F.sum(_c(c)), F.lit(0.0))


def nan_null(c: Column | str) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def mean_na(c: Column | str) -> Column:
    """Mean over values that are neither NULL nor NaN."""
    return F.avg(nan_null(_c(c).cast("double")))


def not_in(c: Column | str, values) -> Column:
    """Not one of ``values``; rows with NULL pass."""
    return ~F.coalesce(_c(c).isin(list(values)), F.lit(False))


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a), _c(b))


def ln0(c: Column | str) -> Column:
    """Natural log, NULL for values that have none."""
    c = _c(c)
    return F.when(c > 0, F.ln(c))


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Join parts as text; a missing part becomes the text NA."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    fl = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_null(c) for c in fl}) if fl else df


def drop_na_any(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) or None)


def drop_na_all(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(how="all", subset=list(cols) or None)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fail while running if a key occurs twice; costs one aggregate on the keys."""
    bad = (df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")))
    guard = F.assert_true(bad.scalar() == 0, F.lit(f"duplicate key {keys}")).isNull()
    return df.where(guard)
