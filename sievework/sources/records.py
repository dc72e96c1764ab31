"""Flat assay rows out of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, scales
from ..functions.sequences import mass_residue_total


def flatten_records(records: DataFrame) -> DataFrame:
    """A row for each MIC entry of each record of canonical letters, with the record's least human HC50 and its censoring.

    Entries of other measures and records without MIC give no row; a MIC whose unit doesn't
    convert stays, as null.
    """
    weight = mass_residue_total(F.col("sequence"), parsing.MASSES, parsing.WATER)

    def micromolar(entry: Column) -> Column:
        return parsing.to_micromolar(parsing.concentration(entry["concentration"]), parsing.unwrap(entry["unit"]), weight)

    def human(entry: Column) -> Column:
        target = F.lower(parsing.unwrap(entry["targetCell"]))
        return target.contains("erythrocyte") & target.contains("human")

    hemolysis = F.transform(
        F.filter("hemoliticCytotoxicActivities", human),
        lambda e, i: F.struct(micromolar(e).alias("value"), i.alias("place"), F.trim(e["concentration"]).startswith(">").alias("censored")),
    )
    blank = F.coalesce(parsing.unwrap(F.col("nTerminus")), F.lit(""))
    tail = F.coalesce(parsing.unwrap(F.col("cTerminus")), F.lit(""))
    no = [F.coalesce(F.size(c), F.lit(0)) < 1 for c in ("unusualAminoAcids", "intrachainBonds", "interchainBonds")]
    rows = (
        records.withColumn("sequence", F.upper(F.trim("sequence")))
        .where(F.col("sequence").rlike(f"^[{scales.ALPHABET}]+$"))
        .withColumn("hc50", F.array_min(F.filter(hemolysis, lambda e: e["value"].isNotNull())))
        .withColumn("entry", F.explode("targetActivities"))
        .where(parsing.unwrap(F.col("entry.activityMeasureGroup")) == "MIC")
    )
    return rows.select(
        "id", "sequence", F.length("sequence").alias("length"), parsing.unwrap(F.col("entry.targetSpecies")).alias("species"),
        micromolar(F.col("entry")).alias("mic_uM"), F.lit("MIC").alias("measure"), F.col("entry.concentration").alias("raw_conc"), parsing.unwrap(F.col("entry.unit")).alias("unit"),
        F.col("hc50.value").alias("human_hc50_uM"), F.coalesce("hc50.censored", F.lit(False)).alias("hc50_censored"),
        blank.alias("n_term"), tail.alias("c_term"), ((blank == "") & (tail == "")).alias("free_termini"), (no[0] & no[1] & no[2]).alias("unmodified"),
        (F.lower(F.coalesce(parsing.unwrap(F.col("complexity")), F.lit(""))) == "monomer").alias("monomer"),
    )
