"""NumPy archives as tables: a batch reader by ranges of rows and a writer, as a Python data source.

``spark.dataSource.register(NpzSource)``, then ``spark.read.format("npz").load(path)``. Each array of
an archive is a column, its first axis the rows; a second axis makes an array column. Arrays are read
without unpickling anything, and a range of rows is read by seeking in the member, which needs
no other bytes where it isn't compressed.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from .attempts import Attempts, Written, data_files

RANGE, FILE = 1 << 16, 1 << 20  # rows of a partition that is read, and of a file that is written
KINDS = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType()}


@dataclass
class _Range(InputPartition):
    file: str
    first: int
    last: int


def _header(member) -> tuple[tuple, bool, np.dtype]:
    """(shape, whether Fortran order, type) of a member, which then stands at its data."""
    version = np.lib.format.read_magic(member)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)


def _members(path: str, file: str):
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(store.open_input_file(file))


def _shapes(path: str, file: str) -> dict[str, tuple[tuple, np.dtype]]:
    """Each array's shape and type, from headers alone."""
    out = {}
    with _members(path, file) as archive:
        for name in archive.namelist():
            with archive.open(name) as member:
                shape, fortran, kind = _header(member)
                if kind.kind not in KINDS or not 1 <= len(shape) <= 2 or fortran and len(shape) == 2 and min(shape) > 1:
                    raise ValueError(f"{file}: {name} isn't a table's column: {kind} {shape}")
                out[name.removesuffix(".npy")] = (shape, kind)
    if len({s[0] for s, _ in out.values()}) > 1:
        raise ValueError(f"{file}: its arrays have different numbers of rows")
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.names = path, [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        ranges = []
        for file in data_files(self.path):
            rows = next((s[0] for s, _ in _shapes(self.path, file).values()), 0)
            ranges += [_Range(file, at, min(at + RANGE, rows)) for at in range(0, rows, RANGE)]
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        columns, n = [], partition.last - partition.first
        with _members(self.path, partition.file) as archive:
            for name in self.names:
                with archive.open(f"{name}.npy") as member:
                    shape, _, kind = _header(member)
                    width = int(np.prod(shape[1:], dtype=np.int64))
                    member.seek(partition.first * width * kind.itemsize, 1)
                    values = np.frombuffer(member.read(n * width * kind.itemsize), kind).astype({"f": np.float64, "b": bool}.get(kind.kind, np.int64))
                flat = pa.array(values)
                columns.append(flat if len(shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat))
        yield pa.RecordBatch.from_arrays(columns, names=self.names)


class _Writer(Attempts, DataSourceArrowWriter):
    """A file for each ``FILE`` rows of a task, all of which it holds."""

    suffix = ".npz"

    def __init__(self, path: str, overwrite: bool) -> None:
        super().__init__(path, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name, part = self.attempt()
        files, held, rows = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            files.append(f"{name}-{len(files):05d}")
            with store.open_output_stream(files[-1]) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                for column in table.column_names:
                    with archive.open(f"{column}.npy", "w", force_zip64=True) as member:
                        np.lib.format.write_array(member, _array(table.column(column).combine_chunks(), column), allow_pickle=False)

        for batch in iterator:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FILE:
                flush()
                held, rows = [], 0
        if rows:
            flush()
        return Written(files, part)


def _array(column: pa.Array, name: str) -> np.ndarray:
    """A column as one array; missing numbers are nan, other missing values and lists of unequal lengths are refused."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    nested = pa.types.is_list(column.type)
    flat = column.flatten() if nested else column
    if nested and column.null_count or flat.null_count and not pa.types.is_floating(flat.type):
        raise ValueError(f"column {name} has nulls, which an array can't hold")
    values = flat.to_numpy(zero_copy_only=False)
    if not nested:
        return values
    if len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError(f"column {name} has lists of different lengths")
    return values.reshape(len(column), -1)


class NpzSource(DataSource):
    """The ``npz`` format; the path may be local or of any store that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        """From the first file's headers: whole numbers are bigint, real ones double."""
        shapes = _shapes(self.options["path"], data_files(self.options["path"])[0])
        kind = lambda shape, t: KINDS[t.kind] if len(shape) == 1 else T.ArrayType(KINDS[t.kind])
        return T.StructType([T.StructField(n, kind(*s)) for n, s in shapes.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The arrays of one archive, or of all archives of a folder, as columns."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").load(path)


def write_npz(df: DataFrame, path: str, mode: str = "append") -> None:
    """A folder of archives with an array for each column: numbers, booleans, or lists of them of one length."""
    df.sparkSession.dataSource.register(NpzSource)
    df.write.format("npz").mode(mode).save(path)
