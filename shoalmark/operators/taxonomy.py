"""Matching labels to a hierarchy with fallback to higher ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ordering import first_per_key

RANKS = ("genus", "subfamily", "family", "order", "class", "super_class")
# A match at a rank keeps that rank and the ones above it.
MATCH_RANKS = ("genus", "family", "order")


def rank_lookup(taxonomy: DataFrame, ranks: Sequence[str] = RANKS,
                match: Sequence[str] = MATCH_RANKS) -> DataFrame:
    """One row per matchable name: the lowest rank it names, with the ranks at or above it."""
    def level(i: int, rank: str) -> DataFrame:
        kept = ranks[ranks.index(rank):]
        return taxonomy.where(F.col(rank).isNotNull()).select(
            F.col(rank).alias("name"), F.lit(i).alias("_priority"),
            *[(F.col(c) if c in kept else F.lit(None).cast("string")).alias(c) for c in ranks])
    stacked = reduce(DataFrame.union, [level(i, c) for i, c in enumerate(match)])
    best = first_per_key(stacked, ["name"], ["_priority", *ranks])
    return best.withColumnRenamed("_priority", "matched")


def rank_fallback_join(names: DataFrame, name_col: str, taxonomy: DataFrame,
                       ranks: Sequence[str] = RANKS, match: Sequence[str] = MATCH_RANKS,
                       keep_rank: bool = False) -> DataFrame:
    """Match names to genus, else family, else order; names found nowhere are dropped."""
    look = rank_lookup(taxonomy, ranks, match)
    if keep_rank:
        label = F.element_at(F.array(*[F.lit(m) for m in match]), F.col("matched") + 1)
        look = look.withColumn("matched", label)
    else:
        look = look.drop("matched")
    return names.join(look.withColumnRenamed("name", name_col), name_col)
