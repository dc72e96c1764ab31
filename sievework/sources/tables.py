"""Readers and writers of the other formats, with schemas of their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSAYS = "sequence string, amidated int, species string, gram string, mic_uM double, censored boolean"
#: Leaves that may be a string or an object stay strings, whatever the files at hand hold.
RECORDS = (
    "id string, sequence string, nTerminus string, cTerminus string, complexity string, unusualAminoAcids array<string>, intrachainBonds array<string>, interchainBonds array<string>, "
    "hemoliticCytotoxicActivities array<struct<targetCell:string,concentration:string,unit:string>>, "
    "targetActivities array<struct<activityMeasureGroup:string,targetSpecies:string,concentration:string,unit:string>>"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, gzipped or not."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str, *, compression: str | None = "gzip", skip_empty: bool = False) -> bool:
    """CSV with a header, gzipped unless told otherwise; with ``skip_empty`` a table without rows writes nothing. Whether it was written."""
    if skip_empty and df.isEmpty():
        return False
    df.write.csv(path, header=True, compression=compression or "none", mode="overwrite")
    return True


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """Text files with a line for each value that isn't null; with ``order`` one file in that order."""
    rows = df.where(F.col(column).isNotNull())
    rows = rows.orderBy(order).coalesce(1) if order else rows
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each token of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("token")).where("token <> ''")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON documents, one a file; malformed ones are dropped."""
    return spark.read.json(path, schema=RECORDS, multiLine=True, mode="DROPMALFORMED")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of controls or vectors; NumPy archives are read by ``npz.read_npz``."""
    return spark.read.parquet(path)


def manifest(tables: dict[str, DataFrame]) -> str:
    """The tables' row counts as JSON, counted in one job."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    return json.dumps({r.name: r.n for r in counts.collect()} if counts is not None else {}, indent=1, sort_keys=True)
