"""Documents and their token counts in flat token files: a vectorised separator scan by blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import emptied, slices
from .common import bounded_batches, checkpoint, shared_dir, table
from .tokenise import WordEncoder, tokenizer_file

END = 0xFFFF  # beyond the ids of word_bpe_49k, so that no text encodes to it
SHARD = 16 << 20  # most bytes of a file, but for a longer text
BLOCK = 1 << 20  # bytes that one scan looks at
RUN = 16  # blocks of a file that go to one task in a row


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Every text's ids and the end id, as unsigned 16 bit little endian, in flat files in ``folder``.

    ``end`` lies beyond the vocabulary's ids, special tokens included: a text that holds one of
    these literally encodes to it, which must not look like an end.
    ``folder`` is one that all executors share. A task writes files of some ``SHARD`` bytes,
    named by its attempt, so that an attempt that was lost leaves files nobody asks for.
    Null and empty texts are the end alone; null and repeated ids and repeated rows are written
    like others; an empty table writes nothing; other columns are not read. A vocabulary whose
    ids don't fit 16 bits below ``end`` is refused.
    Returns the manifest, kept in the shared folder: file, doc_no (from 0 in its file), id.
    """
    vocabulary = tokenizer_file() if vocabulary is None else vocabulary
    from tokenizers import Tokenizer

    if not max(Tokenizer.from_str(vocabulary).get_vocab(with_added_tokens=True).values(), default=-1) < end <= 0xFFFF:
        raise ValueError(f"separator {end} must be beyond the vocabulary's ids and fit 16 bits")
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        encoder, attempt = WordEncoder(vocabulary, end), TaskContext.get().taskAttemptId()
        number, held = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number
            name = f"{attempt:08d}-{number:05d}.bin"
            with store.open_output_stream(f"{root}/{name}") as file:
                for _, ids in held:
                    file.write(ids.astype("<u2").tobytes())
            names = pa.concat_arrays([x for x, _ in held])
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name] * len(names)), pa.array(np.arange(len(names))), names], names=["file", "doc_no", "id"])

        for rows, data, ends in slices(batches, "text", 1 << 20):
            ids, _ = encoder.encode(data, ends)
            held.append((rows.column(0), ids))
            if 2 * sum(len(x) for _, x in held) >= SHARD:
                yield flush()
        if held:
            yield flush()

    return checkpoint(source.mapInArrow(lambda it: emptied(run(it)), f"file string, doc_no bigint, id {source.schema['id'].dataType.simpleString()}"))


def scan_token_files(spark: SparkSession, folder: str, *, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """A row per document of each ``*.bin`` file: file, doc_no, start, n_tokens, closed.

    The files hold unsigned little-endian ids of ``width`` bytes (2 or 4) and nothing else; a
    document ends at the ``end`` id, which isn't counted, or, not closed, at the file's end;
    a file's last ids without ``end`` are a document, nothing behind the last ``end`` is none,
    and a trailing part of an id is ignored. Spark lists the files, but doesn't read them:
    tasks read blocks of ``block`` bytes by their range, so that no file needs to fit a row or
    a task, and search each by itself for the places of ``end``. A prefix scan over the blocks'
    sums, a small row for each block of a file, then gives the documents before each block and where the one that is open began.
    An empty file or folder gives no rows.
    """
    block -= block % width
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).where("length > 0")
    blocks = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block))).alias("block"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.withColumn("run", F.floor(F.col("block") / RUN)).repartition(partitions, "file", "run").sortWithinPartitions("file", "block").select("file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            found, n = [], []
            for own, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    name, file = own, store.open_input_file(f"{root}/{own}")
                raw = file.read_at(block, k * block)
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                found.append(np.flatnonzero(ids == end))
                n.append(len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), places], names=["file", "block", "n", "ends"])

    searched = checkpoint(blocks.mapInArrow(lambda it: emptied(search(it)), "file string, block bigint, n bigint, ends array<bigint>"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    base = F.col("block") * (block // width)
    # a row of a few numbers for each block is scanned, never the ends themselves
    scanned = (
        searched.select("file", "block", "n", F.size("ends").alias("held"), F.when(F.size("ends") > 0, base + F.element_at("ends", -1)).alias("last"))
        .withColumn("docs_before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
        .withColumn("opened", F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("final", F.col("block") == F.max("block").over(whole))
        .select("file", "block", "docs_before", "opened", "total", "final")
    )
    stitched = searched.join(scanned, ["file", "block"])
    stops = F.when(F.col("final"), F.concat("ends", F.array(F.col("total") - base))).otherwise(F.col("ends"))
    places = stitched.select("*", F.posexplode(stops).alias("nth", "place"))
    start = F.when(F.col("nth") > 0, base + F.get("ends", F.col("nth") - 1) + 1).otherwise(F.col("opened"))
    closed = F.col("nth") < F.size("ends")
    return places.select(
        "file", (F.col("docs_before") + F.col("nth")).alias("doc_no"), start.alias("start"), (base + F.col("place") - start).alias("n_tokens"), closed.alias("closed")
    ).where("closed or n_tokens > 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents, found in flat files of their ids, which are gone afterwards."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    try:
        manifest = write_token_files(table(spark, sf_dir, "documents"), path.toUri().toString() if path.toUri().getScheme() else path.toString())
        found = scan_token_files(spark, folder)
        return checkpoint(manifest.join(found.where("closed").hint("merge"), ["file", "doc_no"], "left").select(F.col("id").alias("doc_id"), "n_tokens"))
    finally:
        store.delete(path, True)
