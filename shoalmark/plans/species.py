"""From survey codes to a species list with taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as K, fixed_values as V
from ..functions.nulls import not_in
from ..operators.joins import members, non_members
from ..operators.sets import bind_rows
from ..operators.taxonomy import RANKS, rank_fallback_join


def species_list(codes: DataFrame, names: DataFrame, synonyms: DataFrame, taxonomy: DataFrame,
                 other_animals: DataFrame) -> DataFrame:
    """(svspp, label, validated_species, ranks...)

    ``codes(svspp)`` are the codes in the catch, ``names(svspp, sciname)`` their raw names,
    ``synonyms(label, validated_species)`` the accepted names and ``other_animals(label)`` names to
    leave out. Labels without an accepted name are matched by first word to a higher rank; labels
    matched nowhere are dropped.
    """
    label = K.recode(K.sentence_case("sciname"), V.NAME_FIXES)
    listed = members(names, codes, "svspp").select("svspp", label.alias("label"))
    listed = non_members(listed.where(not_in("label", V.REMOVED_LABELS)), other_animals, "label")
    known = listed.join(synonyms, "label", "left")
    by_species = taxonomy.withColumnRenamed("species", "validated_species")
    accepted = known.where("validated_species IS NOT NULL").join(
        by_species, "validated_species", "left").select("svspp", "label", "validated_species", *RANKS)
    rest = known.where("validated_species IS NULL").select(
        "svspp", "label", K.recode(K.word("label", 0), V.FIRST_WORD_FIXES).alias("_first"))
    higher = (rank_fallback_join(rest, "_first", taxonomy).where("super_class IS NOT NULL")
              .select("svspp", "label", *RANKS))
    return bind_rows(accepted, higher)
