"""FASTA files: a batch reader and a writer as a Python data source.

``spark.dataSource.register(FastaSource)``, then ``spark.read.format("fasta").load(path)``
gives (file, nth, header, sequence); a file is a partition. Text before the first header is
dropped, wrapped lines are joined and upper-cased, records without letters stay. The writer
takes (header, sequence) in the frame's order, a file for each partition; it appends or overwrites
as asked, all files of a job or none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from .attempts import Attempts, Written, data_files

SCHEMA = "file string, nth int, header string, sequence string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(header, sequence) of each record."""
    header, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts).upper()
            header, parts = line[1:].strip(), []
        elif line and header is not None:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts).upper()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(file) for file in data_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import io

        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as raw:
            for nth, (header, sequence) in enumerate(records(io.TextIOWrapper(raw, "utf-8"))):
                yield partition.value.rpartition("/")[2], nth, header, sequence


class _Writer(Attempts, DataSourceWriter):
    """A file for each task."""

    suffix = ".fasta"

    def __init__(self, path: str, overwrite: bool) -> None:
        super().__init__(path, overwrite)

    def write(self, iterator: Iterator) -> Written:
        store, file, part = self.attempt()
        with store.open_output_stream(file) as out:
            for row in iterator:
                out.write(f">{row.header}\n{row.sequence}\n".encode())
        return Written([file], part)


class FastaSource(DataSource):
    """The ``fasta`` format; the path may be local or of any store that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file or of all files of a folder."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").load(path)


def write_fasta(df: DataFrame, path: str, order: str, prefix: str = "seq", seq: str = "sequence") -> None:
    """``>prefix1`` and so on in the order of a column of places from 1, in one file as validators want it.

    The rows are those of a final list; their place is given, so they are only sorted.
    """
    df.sparkSession.dataSource.register(FastaSource)
    rows = df.orderBy(order).select(F.concat(F.lit(prefix), F.col(order).cast("string")).alias("header"), F.col(seq).alias("sequence"))
    rows.coalesce(1).write.format("fasta").mode("append").save(path)
