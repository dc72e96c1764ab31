"""Checks of a library, a list and a reference, as counts that a report collects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import is_sequence


def report(library: DataFrame, top: DataFrame, reference: DataFrame, *, seq: str = "sequence", size: int | None = None, top_size: int | None = None, shortest: int = 8, longest: int = 50) -> DataFrame:
    """One row per check: name, value (violations, or a size), ok."""
    def rows(df: DataFrame, name: str, value, limit: int | None = 0) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("check"), "value", (F.lit(True) if limit is None else F.col("value") == F.lit(limit)).alias("ok"))

    bad = F.sum(F.when(is_sequence(F.col(seq), shortest, longest), 0).otherwise(1))
    return (
        rows(library, "library_size", F.count("*"), size)
        .union(rows(top, "top_size", F.count("*"), top_size))
        .union(rows(library, "library_invalid", F.coalesce(bad, F.lit(0))))
        .union(rows(library, "library_repeats", F.count(seq) - F.countDistinct(seq)))
        .union(rows(top, "top_repeats", F.count(seq) - F.countDistinct(seq)))
        .union(rows(top.join(library, seq, "left_anti"), "top_outside_library", F.count("*")))
        .union(rows(library.join(reference, seq, "left_semi"), "library_in_reference", F.count("*")))
    )
