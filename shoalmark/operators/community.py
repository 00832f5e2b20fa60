"""Community-weighted means.

Everything stays in long form (site, species, weight): no site x species matrix is built, so the
number of species is not limited and absent species cost nothing. Each step is an aggregate with a
map-side partial, so a site or species that holds a large share of the rows is reduced before it
is shuffled; the join to the traits is left to the optimizer, which broadcasts the trait table
only when its size allows and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import ratio, strict_sum


def tow_totals(catch: DataFrame, drop: Sequence[str] = ("length_cm",), sex_col: str = "catchsex",
               measures: Sequence[str] = ("abundance", "biomass_kg")) -> DataFrame:
    """Collapse fish rows to catch rows, then merge the sex classes by strict sums.

    Groups by every column that is neither dropped, nor the sex class, nor a measure.
    """
    per_catch = catch.drop(*drop).distinct()
    keys = [c for c in per_catch.columns if c != sex_col and c not in measures]
    return per_catch.groupBy(*keys).agg(*[strict_sum(m).alias(m) for m in measures])


def cwm(catch: DataFrame, traits: DataFrame, site_cols: Sequence[str], species_col: str,
        weight_col: str, trait_cols: Sequence[str], na_policy: str = "drop_species") -> DataFrame:
    """Mean of each trait over the species of a site, weighted by ``weight_col``.

    ``drop_species`` leaves out species with a missing trait, weights included.
    ``propagate`` follows matrix algebra: a trait missing for any sampled species is missing at
    every site. A missing weight makes its site missing, a zero total gives NULL.
    """
    if na_policy not in ("drop_species", "propagate"):
        raise ValueError(na_policy)
    t = traits.select(species_col, *trait_cols)
    lost = None
    if na_policy == "drop_species":
        t = t.dropna(how="any", subset=list(trait_cols))
    else:
        seen = t.join(catch.select(species_col).distinct(), species_col, "left_semi")
        lost = seen.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c)
                          for c in trait_cols])
        t = t.fillna(0.0, subset=list(trait_cols))
    rows = catch.select(*site_cols, species_col, weight_col).join(t, species_col)
    w = F.col(weight_col)
    out = rows.groupBy(*site_cols).agg(
        strict_sum(w).alias("_w"), *[strict_sum(w * F.col(c)).alias(c) for c in trait_cols])
    means = {c: ratio(c, "_w") for c in trait_cols}
    if lost is not None:
        means = {c: F.when(~lost.select(c).scalar(), m) for c, m in means.items()}
    return out.select(*site_cols, *[m.alias(c) for c, m in means.items()])


def cwm_by_proportion(catch: DataFrame, traits: DataFrame, site_cols: Sequence[str],
                      species_col: str, weight_col: str, trait_cols: Sequence[str]) -> DataFrame:
    """The same means by another road: proportions within the site first, then their products."""
    t = traits.select(species_col, *trait_cols).dropna(how="any", subset=list(trait_cols))
    rows = (catch.select(*site_cols, species_col, weight_col).join(t, species_col)
            .groupBy(*site_cols, species_col, *trait_cols)
            .agg(strict_sum(weight_col).alias("_b")))
    total = rows.groupBy(*site_cols).agg(strict_sum("_b").alias("_total"))
    share = rows.join(total, list(site_cols)).withColumn("_p", ratio("_b", "_total"))
    return share.groupBy(*site_cols).agg(
        *[strict_sum(F.col("_p") * F.col(c)).alias(c) for c in trait_cols])


def row_total(catch: DataFrame, site_cols: Sequence[str], weight_col: str) -> DataFrame:
    return catch.groupBy(*site_cols).agg(strict_sum(weight_col).alias("total"))
