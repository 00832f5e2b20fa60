"""Trait database, its principal components and stock-level traits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as K
from ..functions.nulls import drop_na_all, ln0
from ..operators.aggregates import mean_across
from ..operators.joins import members, star_join
from ..operators.pca import PcaFit, fit_pca
from ..operators.sets import bind_rows
from ..operators.trait_sources import RULES, SECOND_ONLY, fill_higher_taxa, trait_gap_fill
from ..session import cut_lineage

STOCK = ["spec_code", "stock_code"]


def trait_database(species: DataFrame, a: DataFrame, b: DataFrame, rules=RULES,
                   second_only=SECOND_ONLY, label: str = "B") -> DataFrame:
    """Merged traits of all listed species and of labels known only above species level.

    ``species(svspp, label, species)`` has a NULL species for the latter.
    """
    merged = trait_gap_fill(species, a, b, rules=rules, second_only=second_only, label=label)
    named = merged.join(species.select("species", "svspp", "label"), "species", "left")
    higher = fill_higher_taxa(species.where("species IS NULL").select("svspp", "label"), b, "label",
                              rules=rules, second_only=second_only, label=label)
    return bind_rows(named, higher)


def log_mean_traits(traits: DataFrame, code: str, cols: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Mean per species over rows with the required traits, on the log scale."""
    rows = traits.dropna(how="any", subset=list(required)) if required else traits
    return K.across(mean_across(rows, [code], cols), cols, ln0)


def trait_pca(traits: DataFrame, code: str, cols: Sequence[str], k: int = 3,
              required: Sequence[str] = ()) -> tuple[PcaFit, DataFrame]:
    """Components of log mean traits: the fit, and the scores per species."""
    means = cut_lineage(log_mean_traits(traits, code, cols, required))
    fit = fit_pca(means, cols, k)
    return fit, fit.scores(means, [code])


def stock_table(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means per stock; stocks with nothing measured are dropped."""
    return drop_na_all(mean_across(rows, STOCK, cols), *cols)


def stock_traits(maturity: DataFrame, fecundity: DataFrame, ecology: DataFrame, popchar: DataFrame,
                 popgrowth: DataFrame, eggs: DataFrame, stocks: DataFrame) -> DataFrame:
    """Six stock tables averaged and joined; only stocks of the wanted areas.

    Both population tables measure the maximum age; the second is named ``tmax_growth`` so that it
    does not become a join key.
    """
    inside = lambda t: members(t, stocks, "stock_code")  # noqa: E731  filter before the aggregates
    center = stock_table(inside(maturity), ["tm", "lm"])
    fec = stock_table(inside(fecundity), ["fecundity_min", "fecundity_max"]).select(
        *STOCK, K.midpoint("fecundity_min", "fecundity_max").alias("fecundity_mean"))
    eco = inside(ecology).select(*STOCK, "schooling", F.coalesce("diet_troph", "food_troph").alias("trophic_num"))
    pop = stock_table(inside(popchar), ["wmax", "lmax", "tmax"])
    grow = stock_table(inside(popgrowth), ["loo", "k", "winfinity", "tmax", "rm"]).withColumnRenamed("tmax", "tmax_growth")
    egg = stock_table(inside(eggs), ["eggdiammin", "eggdiammax", "eggdiammod"]).select(
        *STOCK, K.egg_diameter("eggdiammin", "eggdiammax", "eggdiammod").alias("egg_dia"))
    return star_join(center, [fec, eco, pop, grow, egg], STOCK)
