"""Joins with the missing-key rules of the analysis.

No strategy is forced: sizes grow with the data, so the optimizer picks broadcast or sort-merge
from statistics and splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """Equi-join on differently named keys where missing matches missing; drops the right keys."""
    there = right.withColumnsRenamed({b: f"_k_{b}" for b in keys.values()})
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"_k_{b}")) for a, b in keys.items()])
    return left.join(there, same, how).drop(*[f"_k_{b}" for b in keys.values()])


def natural_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                 null_safe: bool = False) -> DataFrame:
    """Join on all common columns, which must be exactly ``keys``.

    Stating the keys catches a shared measure column that would silently become a key.
    """
    common = [c for c in left.columns if c in right.columns]
    if set(common) != set(keys):
        raise ValueError(f"common columns {common} are not the keys {list(keys)}")
    if not null_safe:
        return left.join(right, list(keys), how)
    return null_safe_join(left, right, {k: k for k in keys}, how)


def members(df: DataFrame, of: DataFrame, key: str, of_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(of.select(F.col(of_key or key).alias(key)), key, "left_semi")


def non_members(df: DataFrame, of: DataFrame, key: str, of_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in another table; rows without a key stay."""
    return df.join(of.select(F.col(of_key or key).alias(key)), key, "left_anti")


def classify_membership(keys: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Where each listed key occurs: only_a, only_b or both; keys found in neither are dropped.

    One aggregate over the stacked keys instead of two joins, so repeated keys are reduced early.
    """
    def flagged(df, name):
        return df.select(key, *[F.lit(n == name).alias(n) for n in ("_l", "_a", "_b")])
    flags = (flagged(keys, "_l").union(flagged(a, "_a")).union(flagged(b, "_b"))
             .groupBy(key).agg(*[F.bool_or(n).alias(n) for n in ("_l", "_a", "_b")]))
    where = (F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a")
             .when(F.col("_b"), "only_b"))
    return flags.where("_l").select(key, where.alias("membership")).where("membership IS NOT NULL")


def star_join(center: DataFrame, arms: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chain of left joins on explicit keys; arms aggregated on the same keys are not shuffled again."""
    for arm in arms:
        clash = (set(center.columns) & set(arm.columns)) - set(keys)
        if clash:
            raise ValueError(f"rename {sorted(clash)} before joining")
        center = center.join(arm, list(keys), "left")
    return center


def enrich_back(rows: DataFrame, source: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Re-attach attributes that are constant per key to aggregated rows.

    A key with two different attribute sets stops the job instead of multiplying rows.
    """
    meta = source.groupBy(*keys).agg(
        F.min(F.struct(*attrs)).alias("_lo"), F.max(F.struct(*attrs)).alias("_hi"))
    one = F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), F.lit("attributes differ within a key"))
    meta = meta.where(one.isNull()).select(*keys, *[F.col(f"_lo.{a}").alias(a) for a in attrs])
    return rows.join(meta, list(keys), "left")
