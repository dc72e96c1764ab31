"""Replicate measurements: joins with their subjects and aggregation in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_subjects(measurements: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Measurements with their subject, of which one row for each key counts."""
    return measurements.join(subjects.dropDuplicates([key]) if subjects.columns == [key] else subjects, key)


def replicate_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and count of each key's replicates; rows with a null key or value don't count."""
    known = df
    for k in [*keys, value]:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def mean_of_logs(medians: DataFrame, keys: list[str], lo: float = 0.05, hi: float = 64.0) -> DataFrame:
    """The mean over the medians' log2, clipped to [lo, hi], and the replicates' number."""
    return medians.groupBy(*keys).agg(F.avg(F.log2(F.least(F.greatest(F.col("median"), F.lit(lo)), F.lit(hi)))).alias("y"), F.sum("n").alias("n"))


def large_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """The rows of the keys that have ``least`` rows or more."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key), key, "left_semi")


def safe_label(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Mean log2, count, and whether the mean reaches the threshold's log2; values that aren't positive don't count."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.avg(F.log2(value)).alias("y"), F.count("*").alias("n")).withColumn("safe", F.col("y") >= F.log2(F.lit(threshold)))


def least_with_flag(entries: str, value: str, flag: str, wanted: Column | None = None) -> Column:
    """Of an array of structs the least value with its flag; the first on ties, null for none."""
    usable = F.filter(F.col(entries), lambda e: e[value].isNotNull())
    placed = F.transform(usable, lambda e, i: F.struct(e[value].alias(value), i.alias("place"), e[flag].alias(flag)))
    return F.array_min(placed)


def potent_weights(subjects: DataFrame, measurements: DataFrame, key: str, value: str, threshold: float = 16.0, more: float = 2.0) -> DataFrame:
    """``subjects`` with ``weight``: ``more`` where the key's median is at most ``threshold``, else 1, also without measurements."""
    potent = measurements.groupBy(key).agg(F.median(value).alias("median")).where(F.col("median") <= threshold).select(key, F.lit(more).alias("weight"))
    return subjects.join(potent, key, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def with_cluster(subjects: DataFrame, clusters: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """``subjects`` with their cluster; a key that no cluster holds is a cluster of its own, named by the key."""
    return subjects.join(clusters.select(key, cluster), key, "left").withColumn(cluster, F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("own:"), F.col(key).cast("string"))))
