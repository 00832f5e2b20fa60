"""Row binding and key sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_list(frames: Iterable[DataFrame]) -> DataFrame:
    return bind_rows(*list(frames))


def keys_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def keys_only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def keys_in_either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
