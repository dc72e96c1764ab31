"""The library's functions by name, for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, similarity


@F.udtf(returnType="place int, gram string", useArrow=True)
class GramTable:
    """``grams(text, k)``: a row for each substring of k letters, with its place from 1; none of null or of a shorter text."""

    def eval(self, text: str, k: int) -> Iterator[tuple[int, str]]:
        for i in range(len(text or "") - k + 1 if k > 0 else 0):
            yield i + 1, text[i : i + k]


def register(spark: SparkSession) -> None:
    """Registers ``sketch_key(text)``, ``indel_ratio(a, b)``, ``local_hit(a, b)``, ``composition_vector(text)`` and the table function ``grams(text, k)``."""
    spark.udf.register("sketch_key", similarity.sketch_key())
    spark.udf.register("indel_ratio", similarity.indel_ratio())
    spark.udf.register("local_hit", alignment.local_hit())
    spark.udf.register("composition_vector", similarity.composition_vector())
    spark.udtf.register("grams", GramTable)
