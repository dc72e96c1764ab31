"""A training corpus from raw documents: five stages, each a table that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import jaccard_join, mixing, packing, quality_cnn, suffix_dedup
from sievework.llm.common import shared_dir, table, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from labels of these documents, doesn't reject."""
    model = quality_cnn.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs.select(COLUMNS), model, out="__score").where("__score >= 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: of the smallest id, null last, then of the smallest hash.

    Rows are named by a hash of all their columns, so that rows of one id, or of none, are
    documents of their own; rows alike in all columns are one. Texts without words link with
    nothing and stay.
    """
    key = F.xxhash64(*[part for c in COLUMNS for part in (F.col(c).isNull(), F.col(c))])
    keyed = docs.select(key.alias("key"), *COLUMNS)
    found = jaccard_join.jaccard_components(keyed, id_col="key").select("key", F.col("component_id").alias("component")).distinct()
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    kept = keyed.select("key", "doc_id").join(found, "key").groupBy("component").agg(one).select("one.key")
    return keyed.join(kept, "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in COLUMNS]).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that repeat; those with nothing left go."""
    cut = suffix_dedup.remove_repeats(docs, keep=["doc_id", "lang", "source"], binary=False)
    return cut.where("n_removed = 0 or n_removed < n_bytes").withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; where a budget ends within one, its first words."""
    mixed = mixing.mix(docs, carry=COLUMNS).select("size", "taken", "carried.*").where("taken > 0")
    copies = mixed.withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.least(F.col("size"), F.col("taken") - F.col("nth") * F.col("size")).cast("int")
    part = F.array_join(F.slice(words(F.col("text")), F.lit(1), left), " ")
    text = F.when(left < F.col("size"), part).otherwise(F.col("text"))
    return copies.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of at most 4096 ids, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_tokens),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
