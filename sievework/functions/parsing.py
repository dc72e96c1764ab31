"""Cleaning and parsing of raw fields, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scales

# Genera that stain positive; any other counts as negative.
GRAM_POSITIVE_GENERA = [
    "Actinomyces", "Bacillus", "Clostridium", "Corynebacterium", "Cutibacterium", "Enterococcus", "Geobacillus", "Kocuria", "Lactobacillus", "Lactococcus", "Leuconostoc",
    "Listeria", "Micrococcus", "Mycobacterium", "Nocardia", "Paenibacillus", "Peptostreptococcus", "Propionibacterium", "Rhodococcus", "Sarcina", "Staphylococcus", "Streptococcus",
]

# Average residue masses to two places, and water.
MASSES = {"A": 71.08, "C": 103.14, "D": 115.09, "E": 129.12, "F": 147.18, "G": 57.05, "H": 137.14, "I": 113.16, "K": 128.17, "L": 113.16, "M": 131.19, "N": 114.10, "P": 97.12, "Q": 128.13, "R": 156.19, "S": 87.08, "T": 101.10, "V": 99.13, "W": 186.21, "Y": 163.18}
WATER = 18.02


def clean_sequence(raw: Column) -> Column:
    """Trimmed and upper-cased."""
    return F.upper(F.trim(raw))


def is_sequence(seq: Column, shortest: int = 8, longest: int = 50) -> Column:
    """Whether all letters are of the alphabet and the length is in range; null isn't one."""
    return F.coalesce(seq.rlike(f"^[{scales.ALPHABET}]{{{shortest},{longest}}}$"), F.lit(False))


def concentration(raw: Column) -> Column:
    """The leading number of a reading such as ``>64``, ``12,5`` or ``2.1-4.2``; null without one."""
    bare = F.replace(F.regexp_replace(F.trim(raw), "^[><≥≤=~ ]+", ""), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(bare, r"^(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def is_censored(raw: Column) -> Column:
    """Whether the reading is a lower bound (``>`` or ``≥``)."""
    return F.coalesce(F.trim(raw).rlike("^[>≥]"), F.lit(False))


def to_micromolar(value: Column, unit: Column, weight: Column) -> Column:
    """Molar units as they are, mass units by the molecular weight, others null."""
    plain = F.lower(F.translate(unit, "µμ", "uu"))
    return F.when(plain.contains("um"), value).when(plain.contains("g/ml") | plain.contains("g/l"), value * 1000 / weight)


def mass_to_molar(value: Column, unit: Column, weight: Column) -> Column:
    """Units with g/ml by the molecular weight; any other passes as it is."""
    return F.when(F.coalesce(F.lower(unit).contains("g/ml"), F.lit(False)), value * 1000 / weight).otherwise(value)


def first_words(text: Column, n: int = 2) -> Column:
    """The first ``n`` words, joined by a space."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def gram_of(species: Column) -> Column:
    """``+`` for a genus known to stain positive, else ``-``."""
    return F.when(F.split(F.trim(species), r"\s+")[0].isin(GRAM_POSITIVE_GENERA), "+").otherwise("-")


def unwrap(leaf: Column) -> Column:
    """A JSON leaf that is a bare string or an object with a name or value."""
    return F.coalesce(F.get_json_object(leaf, "$.name"), F.get_json_object(leaf, "$.value"), leaf)


def header_field(header: Column, field: str = "activity") -> Column:
    """``field=...`` of a header, or the empty string."""
    return F.regexp_extract(header, rf"{field}=(\S+)", 1)


def ceiling_rule(value: Column, censored: Column, ceiling: float = 128.0) -> Column:
    """Censored readings count as the ceiling if they reach it and as null below it; others stay."""
    return F.when(~censored, value).when(value >= ceiling, F.lit(ceiling))


def antilog(value: Column, base: float = 10.0) -> Column:
    """``base`` to the power of ``value``."""
    return F.pow(F.lit(base), value)
