"""Packing token sequences into fixed windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import emptied, slices
from .common import bounded_batches, table
from .tokenise import WordEncoder, tokenizer_file

WINDOW, END = 4096, 2
GROUP = 2 << 20  # tokens that are packed together
SLICE = 1 << 18  # bytes of text that are encoded at a time
ROWS = 512  # pieces of a batch, at most 8 MB of ids
FULL = 15 / 16  # of a window; one less full is cut into powers of two


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts whose leaves are the capacities."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        """``window`` has room for ``capacity`` more."""
        self.at.setdefault(capacity, []).append(window)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window that has room for ``need``, with its capacity; it is open no more."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, largest pieces first (ties in input order), and the number of windows."""
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, used = OpenWindows(window), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            capacity, at = window, used
            used += 1
        else:
            capacity, at = found
        place[i], offset[i] = at, window - capacity
        if capacity > size:
            tree.add(capacity - size, at)
    return place, offset, used


def pack_group(counts: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Pieces of texts with ``counts`` tokens: text, start, length, sequence, offset, in text order.

    Texts are cut into full windows and a rest; the rests are packed best-fit decreasing.
    The pieces of each window that is less than ``FULL`` full, and of the emptiest one, are cut
    once more, into sequences whose lengths are powers of two and so need no padding.
    """
    pieces = -(-counts // window)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = nth * window
    length = np.minimum(window, counts[text] - start)
    place, offset, used = best_fit(length, window)
    fill = np.bincount(place, length, used).astype(np.int64)
    again = fill < FULL * window
    again[fill.argmin() if used else slice(0)] = True
    again &= fill < window
    if again.any():
        cut, moved = [], np.flatnonzero(again[place])
        moved = moved[np.argsort(place[moved], kind="stable")]
        for own in np.split(moved, np.flatnonzero(np.diff(place[moved])) + 1):
            at = int(place[own[0]])
            bits = [1 << k for k in range(window.bit_length()) if fill[at] >> k & 1][::-1]
            edges = np.cumsum([0, *bits]).tolist()
            for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                for i in own.tolist():
                    begin, end = max(lo, int(offset[i])), min(hi, int(offset[i] + length[i]))
                    if begin < end:
                        cut.append((text[i], start[i] + begin - offset[i], end - begin, at if k == 0 else used + k - 1, begin - lo))
            used += len(bits) - 1
        keep = ~again[place]
        text, start, length, place, offset = (np.concatenate([a[keep], np.array(b, np.int64)]) for a, b in zip((text, start, length, place, offset), zip(*cut, strict=True), strict=True))
        order = np.lexsort((start, text))
        text, start, length, place, offset = (a[order] for a in (text, start, length, place, offset))
    return {"text": text, "start": start, "length": length, "sequence": place, "offset": offset}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """All texts' ids, each text's followed by ``end``, packed into sequences of at most ``window`` ids.

    Each task packs what it reads, in groups of about ``group`` ids (a longer text is a group
    of its own), so nothing is shuffled, memory is bounded by a group or the longest text,
    and a lost task is done again alone. Sequence ids are the task's number times 2 ** 32 plus
    a running number. However small a partition is, at most one sixteenth of a sequence is padding.

    Returns a row per piece: ``id_col``, start, length, ids (binary, unsigned 32 bit little
    endian), doc_tokens, sequence_id, offset. Null and empty texts are the end id alone; null
    and repeated ids are as good as others; an empty table gives no rows; other columns are
    not read.
    """
    vocabulary = tokenizer_file() if vocabulary is None else vocabulary
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, following = WordEncoder(vocabulary, end), TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following
            names = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            counts = np.concatenate([np.diff(x[2]) for x in held])
            held.clear()
            found = pack_group(counts, window)
            text, length = found["text"], found["length"]
            for at in range(0, len(text), ROWS):
                to = min(at + ROWS, len(text))
                part = slice(at, to)
                first = int(length[:at].sum())
                size = np.concatenate([[0], np.cumsum(length[part])])
                data = ids[first : first + int(size[-1])]
                column = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((4 * size).astype(np.int32)), pa.py_buffer(data.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(text[part])), *map(pa.array, (found["start"][part], length[part])), column, *map(pa.array, (counts[text[part]], found["sequence"][part] + following, found["offset"][part]))], names=schema.names)
            following += int(found["sequence"].max()) + 1 if len(text) else 0

        waiting = 0
        for rows, data, ends in slices(batches, "text", SLICE):
            ids, text_ends = encoder.encode(data, ends)
            held.append((rows.column(0), ids, text_ends))
            waiting += len(ids)
            if waiting >= group:
                yield from flush()
                waiting = 0
        if held:
            yield from flush()

    return source.mapInArrow(lambda it: emptied(run(it)), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with a digest of their ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
