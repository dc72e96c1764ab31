"""Product codes of vectors in exact integers, learnt by a tree of partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied
from .common import bounded_batches, table, written

BLOCK = 4096  # vectors a block
LARGEST = 1 << 24  # of a component as an integer: squared distances stay within 64 bits
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def integers(column: pa.ListArray, scale: int) -> np.ndarray:
    """A row per component and a column per vector: ``floor(scale * x)`` in 32 bits."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.ascontiguousarray(np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int32).T)


def distances(block: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (part, vector, entry) of a columnar block, one dimension of all parts at a time."""
    parts, entries, width = book.shape
    cells = block.reshape(parts, width, -1)
    total = np.zeros((parts, cells.shape[2], entries), np.int64)
    for d in range(width):
        gap = cells[:, d, :, None].astype(np.int64) - book[:, None, :, d]
        total += gap * gap
    return total


def added(tally: tuple[np.ndarray, np.ndarray], block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tally`` (sums by part, entry and dimension; counts by part and entry) with a block's vectors at their nearest entries."""
    sums, counts = tally
    parts, _, width = book.shape
    nearest = distances(block, book).argmin(axis=2)
    part = np.arange(parts)[:, None]
    np.add.at(sums, (part, nearest), block.reshape(parts, width, -1).transpose(0, 2, 1).astype(np.int64))
    np.add.at(counts, (np.broadcast_to(part, nearest.shape), nearest), 1)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tallies as one."""
    return a[0] + b[0], a[1] + b[1]


def learnt(blocks: RDD, book: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assignments and integer means; an entry that nobody is nearest to stays."""
    for _ in range(rounds):
        held = book
        none = (np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64))
        sums, counts = blocks.treeAggregate(none, lambda tally, block: added(tally, block, held), merged, depth=2)
        book = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], held)
    return book


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            cells = integers(batch.column(0).slice(at, BLOCK), scale)
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["cells"])


def _coded(batches: Iterator[pa.RecordBatch], book: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            if not rows.num_rows:
                continue
            total = distances(integers(rows.column(2), scale), book)
            nearest = total.argmin(axis=2)
            error = np.take_along_axis(total, nearest[:, :, None], axis=2).sum(axis=(0, 2))
            letters = np.stack([HEX[nearest.T >> 4], HEX[nearest.T & 15]], axis=2).reshape(len(error), -1)
            codes = pa.array([bytes(x).decode() for x in letters], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), codes, pa.array(error)], names=["id", "label", "code", "error"])


def vector_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """(rows of id, label, code, error, label_error; the codebooks by part, entry and dimension).

    Vectors that are null, empty, or hold null or non-finite components are dropped.
    Components become ``floor(scale * x)``, at most ``LARGEST`` in magnitude (4,096.0 at the
    default scale; larger ones count as that). Each vector is cut into equal parts, and each
    part has a codebook of at most 256 ``entries``: first that part of the smallest ids' vectors (then
    by vector; null ids last; fewer where there are fewer), then ``rounds`` of integer
    k-means. Vectors of other lengths than the first's, or that can't be cut evenly, are dropped too.

    The vectors are written once as columnar blocks of integers in the shared folder, and
    each round is a ``treeAggregate`` over them: a task keeps one tally of sums and counts, of the
    codebooks' size, and the tallies merge in a tree, so the driver gets few of them. A
    lost executor reads its blocks again; integer sums are the same in any order. Labels
    are summed before a shuffle; null labels are one label. Repeated rows and ids are rows
    like others; an empty table gives no rows and empty codebooks. Other columns are not read.
    """
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0) & (F.size(v) % parts == 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(F.coalesce(fine, F.lit(False)))
    seeds = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector")
    length = next((len(r.vector) for r in seeds.limit(1).collect()), parts)
    rows, seeds = rows.where(F.size("vector") == length), seeds.where(F.size("vector") == length)
    first = pa.array([r.vector for r in seeds.limit(entries).collect()], pa.list_(pa.float64()))
    book = integers(first, scale).reshape(parts, length // parts, -1).transpose(0, 2, 1).astype(np.int64) if len(first) else np.zeros((parts, 0, length // parts), np.int64)
    if len(first):
        cut = written(bounded_batches(rows).select("vector").mapInArrow(lambda it: emptied(_blocks(it, scale)), "cells binary"), "vector-blocks")
        book = learnt(cut.rdd.map(lambda r: np.frombuffer(r.cells, np.int32).reshape(length, -1)), book, rounds)
    names = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).schema
    kinds = f"id {names['id'].dataType.simpleString()}, label {names['label'].dataType.simpleString()}, code string, error bigint"
    coded = written(rows.select("id", "label", "vector").mapInArrow(lambda it: emptied(_coded(it, book, scale)), kinds), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and dimension, joined by commas."""
    return sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    coded, book = vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))


def _nearest(book: str) -> str:
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(c, e)])"
    return f"SELECT r, p, c, min(CAST({gap} AS BIGINT) * 16 + k) AS best FROM parts JOIN {book} USING (p) GROUP BY ALL"


def _round(n: int) -> str:
    return f"""near{n} AS MATERIALIZED ({_nearest(f'book{n - 1}')}),
sums{n} AS (SELECT p, best % 16 AS k, i, sum(c[i]) AS s, count(*) AS m FROM near{n}, range(1, 9) t(i) GROUP BY ALL),
mean{n} AS (SELECT p, k, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS e FROM sums{n} GROUP BY ALL),
book{n} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM book{n - 1} b LEFT JOIN mean{n} m USING (p, k))"""


#: For 64 components, as the tables have.
OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[(p - 1) * 8 + 1 : p * 8] AS c FROM kept, range(1, 9) t(p)),
book0 AS (SELECT p, r - 1 AS k, c AS e FROM parts WHERE r <= 16),
{', '.join(_round(n) for n in range(1, 7))},
last AS MATERIALIZED ({_nearest('book6')}),
digest AS (SELECT sha256(string_agg(x, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM (SELECT p, k, i, CAST(e[i] AS VARCHAR) AS x FROM book6, range(1, 9) t(i))),
coded AS (SELECT r, string_agg(format('{{:02x}}', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM last GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest
"""
