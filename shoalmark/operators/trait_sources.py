"""Merging two trait sources with provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import word
from ..functions.fixed_values import SPECIES_LEVELS, SPECIES_LEVELS_STRICT
from ..functions.nulls import require_unique


@dataclass(frozen=True)
class TraitRule:
    """Traits that share a level code and a reference label."""
    traits: tuple[str, ...]
    level: str
    reference: str
    species_levels: tuple[str, ...] = tuple(SPECIES_LEVELS)


RULES = (
    TraitRule(("trophic_level",), "level_tl", "reference_tl", tuple(SPECIES_LEVELS_STRICT)),
    TraitRule(("age_maturity",), "level_age_maturity", "reference_age_maturity"),
    TraitRule(("fecundity",), "level_fecundity", "reference_fecundity"),
    TraitRule(("l_inf", "k"), "level_growth", "reference_growth"),
    TraitRule(("max_obs_length",), "level_length_max", "reference_length_max"),
    TraitRule(("offspring_size",), "level_offspring_size", "reference_offspring_size"),
)
# Traits only the second source has, with their reference columns.
SECOND_ONLY = {
    "temperature": "reference_temperature",
    "w_inf": "reference_w_inf",
    "natural_mortality": "reference_mortality",
    "length_maturity": "reference_length_maturity",
}


def trait_gap_fill(species: DataFrame, a: DataFrame, b: DataFrame, key: str = "species",
                   rules: Sequence[TraitRule] = RULES, second_only: dict[str, str] = SECOND_ONLY,
                   label: str = "B") -> DataFrame:
    """Trait table of the listed species from source ``a`` (several rows per species, with level
    codes) and source ``b`` (one row per species; a species that occurs twice there is an error).

    A trait of a species present in both is taken from ``b`` for all its rows as soon as one of its
    ``a`` rows is not at species level. Species only in ``b`` give one row, species in neither none.
    """
    listed = species.select(key).where(F.col(key).isNotNull()).distinct()
    a = a.join(listed, key, "left_semi")
    b_traits = [t for r in rules for t in r.traits] + list(second_only)
    b = (require_unique(b, key).join(listed, key, "left_semi")
         .select(key, F.struct(*b_traits).alias("_b")))
    # one row per species: which traits to replace, and the second source's values
    flags = a.groupBy(key).agg(*[
        F.bool_or(~F.coalesce(F.col(r.level).isin(list(r.species_levels)), F.lit(False))).alias(f"_f{i}")
        for i, r in enumerate(rules)])
    merged = flags.withColumn("_in_a", F.lit(True)).join(b, key, "full")
    in_b = F.col("_b").isNotNull()

    both = a.join(merged.where("_in_a"), key)
    new = {}
    for i, rule in enumerate(rules):
        swap = in_b & F.col(f"_f{i}")
        for t in rule.traits:
            new[t] = F.when(swap, F.col(f"_b.{t}")).otherwise(F.col(t))
        new[rule.reference] = F.when(swap, F.lit(label)).otherwise(F.col(rule.reference))
    for t, ref in second_only.items():
        new[t] = F.col(f"_b.{t}")
        new[ref] = F.when(in_b, F.lit(label))
    from_a = both.select(*[new.get(c, F.col(c)).alias(c) for c in a.columns],
                         *[new[c].alias(c) for t in second_only.items() for c in t])
    only_b = merged.where("_in_a IS NULL").select(
        key, *[F.col(f"_b.{t}").alias(t) for t in b_traits],
        *[F.lit(label).alias(c) for c in [r.reference for r in rules] + list(second_only.values())])
    return from_a.unionByName(only_b, allowMissingColumns=True)


def fill_higher_taxa(labels: DataFrame, b: DataFrame, label_col: str, key: str = "species",
                     rules: Sequence[TraitRule] = RULES, second_only: dict[str, str] = SECOND_ONLY,
                     label: str = "B") -> DataFrame:
    """Traits for labels known only above species level: their first word is looked up in ``b``."""
    refs = [r.reference for r in rules] + list(second_only.values())
    traits = [t for r in rules for t in r.traits] + list(second_only)
    taxa = labels.withColumn("_taxon", word(label_col, 0))
    found = b.select(F.col(key).alias("_taxon"), *traits)
    return (taxa.join(found, "_taxon").drop("_taxon")
            .withColumns({c: F.lit(label) for c in refs}))
