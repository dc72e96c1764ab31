"""Descriptors of short sequences as Columns: those that count letters inside the JVM, those that walk along them as vectorised UDFs.

A sequence is a string of at most some 50 letters of ``scales.ALPHABET``. Other letters
count towards lengths only. Null gives null; an empty sequence gives null where a length
divides, else 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches, scales


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def letters(seq: Column) -> Column:
    """The sequence's letters; none for an empty one."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def count_of(seq: Column, members: str) -> Column:
    """How many letters are among ``members``."""
    return F.length(seq) - F.length(F.translate(seq, members, ""))


def fraction(seq: Column, members: str) -> Column:
    """The share of letters among ``members``."""
    return F.try_divide(count_of(seq, members), F.length(seq))


def scale_mean(seq: Column, scale: dict[str, float]) -> Column:
    """The mean of a residue scale, from the composition."""
    total = sum((count_of(seq, a) * v for a, v in scale.items()), F.lit(0.0))
    return F.try_divide(total, F.length(seq))


def charge(seq: Column, ph: Column | float = 7.4) -> Column:
    """Net charge by Henderson and Hasselbalch, both ends free."""
    ph = ph if isinstance(ph, Column) else F.lit(ph)

    def gained(pka: float) -> Column:
        return 1 / (1 + F.pow(F.lit(10.0), ph - pka))

    def lost(pka: float) -> Column:
        return 1 / (1 + F.pow(F.lit(10.0), F.lit(pka) - ph))

    out = gained(scales.PKA_FIRST) - lost(scales.PKA_LAST)
    for a, pka in scales.PKA_POSITIVE.items():
        out = out + count_of(seq, a) * gained(pka)
    for a, pka in scales.PKA_NEGATIVE.items():
        out = out - count_of(seq, a) * lost(pka)
    return F.when(seq.isNotNull(), out)


def isoelectric_point(seq: Column, steps: int = 40) -> Column:
    """The pH at which the charge vanishes, by ``steps`` halvings of 0 to 14."""

    def found(s: pd.Series) -> pd.Series:
        b = batches.Batch(s)
        return b.series(b.isoelectric(steps))

    return F.pandas_udf(found, "double")(seq)


def moment(seq: Column, window: int = 11, angle: float = 100.0, *, truncate_tail: bool = True) -> Column:
    """The largest hydrophobic moment over the windows.

    With ``truncate_tail`` the windows at the end count too, though they hold fewer letters;
    without it only full ones do, or the whole of a sequence shorter than a window.
    """

    def found(s: pd.Series) -> pd.Series:
        b = batches.Batch(s)
        return b.series(b.moment(window, angle, truncate_tail))

    return F.pandas_udf(found, "double")(seq)


def longest_run(seq: Column, members: str) -> Column:
    """The longest stretch of letters among ``members``."""
    runs = F.regexp_extract_all(seq, F.lit(f"([{members}]+)"), F.lit(1))
    return F.when(seq.isNotNull(), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)))


def longest_repeat(seq: Column) -> Column:
    """The longest stretch of one letter."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.when(seq.isNotNull(), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)))


def pair_weight_index(seq: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """10 / length times the weights of neighbouring pairs, such as the instability index's; 0 for fewer than two letters.

    ``weights`` holds the pairs whose weight isn't ``default``: a published table that the
    caller supplies.
    """
    n = F.length(seq)
    table = _literal_map(weights) if weights else F.create_map().cast("map<string,double>")
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda t, i: t + F.coalesce(F.element_at(table, F.substring(seq, i, F.lit(2))), F.lit(default)))
    return F.when(n >= 2, 10 / n * total).when(n.isNotNull(), 0.0)


def aliphatic_index(seq: Column) -> Column:
    """100 (A + 2.9 V + 3.9 (I + L)) over fractions."""
    return 100 * (fraction(seq, "A") + 2.9 * fraction(seq, "V") + 3.9 * fraction(seq, "IL"))


def most_in_window(seq: Column, members: str = scales.POSITIVE, window: int = 5) -> Column:
    """The most letters among ``members`` in any window, or in the whole of a shorter sequence."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq) - window + 1, F.lit(1)))
    return F.when(seq.isNotNull(), F.array_max(F.transform(starts, lambda i: count_of(F.substring(seq, i, F.lit(window)), members))))


def codes(seq: Column, alphabet: str = scales.ALPHABET, first: int = 0, other: int = -1) -> Column:
    """The letters' places in ``alphabet``, counted from ``first``; ``other`` for letters that aren't in it."""
    letters = F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))
    return F.when(seq.isNotNull(), F.transform(letters, lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1 + first).otherwise(other)))


def with_controls(seq: Column, controls: list[Column], offsets: list[int], begin: int, end: int, alphabet: str = scales.ALPHABET) -> Column:
    """A model's input: ``begin``, each control bin moved by its offset, the letters' codes, ``end``."""
    prefix = F.array(F.lit(begin), *[(c + o).cast("int") for c, o in zip(controls, offsets, strict=True)])
    return F.concat(prefix, codes(seq, alphabet), F.array(F.lit(end)))


def face_fraction(seq: Column, angle: float = 100.0) -> Column:
    """Of the letters within 90 degrees of the moment's direction the share that is hydrophobic; 0 without a direction."""

    def found(s: pd.Series) -> pd.Series:
        b = batches.Batch(s)
        return b.series(b.face(angle))

    return F.pandas_udf(found, "double")(seq)


def grams(seq: Column, k: int) -> Column:
    """The substrings of ``k`` letters in order, repeats included; none of a shorter sequence.

    One pass of a look-ahead finds them, also in long texts. It moves by UTF-16 units, so text
    with characters beyond the first plane is cut letter by letter.
    """
    n = F.length(seq)
    wide = seq.rlike(r"[^\x{0}-\x{FFFF}]")
    by_letter = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= k, F.when(wide, by_letter).otherwise(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie strictly below the value."""
    return F.when(value.isNotNull(), sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0)))


def mass_residue_total(seq: Column, masses: dict[str, float], water: float) -> Column:
    """Molecular weight: residue masses and one water; the two published tables differ, so the caller gives one."""
    return sum((count_of(seq, a) * m for a, m in masses.items()), F.lit(water))


def hinge(value: Column, knee: float, weight: float) -> Column:
    """``weight`` for each unit above ``knee``."""
    return F.lit(weight) * F.greatest(F.lit(0.0), value - knee)


def band(value: Column, lo: float, hi: float, width: float) -> Column:
    """1 within [lo, hi], falling to 0 over ``width`` on either side."""

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    return F.least(clip((value - (lo - width)) / width), clip(((hi + width) - value) / width))


def has_hard_pair(seq: Column) -> Column:
    """Whether an aspartimide-forming or NG pair occurs."""
    return seq.rlike(f"D[{scales.ASPARTIMIDE}]|NG")


def has_amide_pair(seq: Column) -> Column:
    """Whether QQ or NN occurs."""
    return seq.rlike("QQ|NN")


def loosely_buildable(seq: Column) -> Column:
    """The loose rules: no C, no letter over 4 times in a row, no sheet-prone stretch over 6."""
    return ~seq.contains("C") & (longest_repeat(seq) <= 4) & (longest_run(seq, scales.SHEET_PRONE) <= 6)


def strictly_buildable(seq: Column) -> Column:
    """All rules, the cheap ones first."""
    return (
        ~seq.rlike("[CM]") & ~seq.startswith("Q") & ~has_hard_pair(seq) & ~has_amide_pair(seq) & F.length(seq).between(11, 26)
        & (longest_repeat(seq) <= 3) & (longest_run(seq, scales.SHEET_PRONE) <= 5) & (most_in_window(seq) <= 4)
        & (fraction(seq, scales.SHEET_FORMERS) <= 0.42) & (charge(seq) >= 2.0) & (scale_mean(seq, scales.HYDROPATHY) <= 1.0)
    )


def risk(seq: Column) -> Column:
    """The graded penalty, 0 to 3."""
    total = (
        0.35 * count_of(seq, "C") + 0.10 * count_of(seq, "M") + 0.15 * has_hard_pair(seq).cast("int") + 0.15 * has_amide_pair(seq).cast("int")
        + hinge(longest_repeat(seq), 3, 0.12) + hinge(longest_run(seq, scales.SHEET_PRONE), 4, 0.12)
        + hinge(longest_run(seq, "R"), 2, 0.08) + hinge(longest_run(seq, "G"), 2, 0.08)
        + hinge(scale_mean(seq, scales.HYDROPATHY), 0.5, 0.20) + hinge(-charge(seq), -2.0, 0.20) + hinge(F.length(seq), 26, 0.03)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(3.0), total))


def envelope(seq: Column) -> Column:
    """How well a sequence sits in the envelope, 0 to 1."""
    lys, arg = fraction(seq, "K"), fraction(seq, "R")
    value = {
        "eisenberg": scale_mean(seq, scales.EISENBERG), "gravy": scale_mean(seq, scales.HYDROPATHY), "hydrophobic": fraction(seq, scales.HYDROPHOBIC),
        "charge_density": F.try_divide(charge(seq), F.length(seq)), "leu": fraction(seq, "L"), "lys": lys, "arg_share": arg / F.greatest(lys + arg, F.lit(1e-9)),
        "aromatic": fraction(seq, scales.AROMATIC), "length": F.length(seq).cast("double"),
    }
    weight = sum(t[0] for t in scales.ENVELOPE.values())
    return sum((w * band(value[name], lo, hi, width) for name, (w, lo, hi, width) in scales.ENVELOPE.items()), F.lit(0.0)) / weight


def descriptors(seq: Column, pair_weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The named descriptors of a sequence; the pair-weight index (``instability``), whose table is a parameter, where one is given.

    One vectorised UDF makes them all, and Spark runs it once for a row, however many of them are asked for.
    """
    names = list(batches.descriptors(pd.Series([], dtype=object), pair_weights).columns)
    all_ = F.pandas_udf(lambda s: batches.descriptors(s, pair_weights), ", ".join(f"{n} double" for n in names))(seq)
    return {n: all_[n].cast("int") if n in batches.WHOLE else all_[n] for n in names}
