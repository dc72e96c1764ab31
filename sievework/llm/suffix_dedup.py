"""Removal of repeated byte strings by bucket-pointer refinement of suffixes, spread over anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied, slices, utf8
from .common import bounded_batches, checkpoint, table, written
from .shingles import BACK, BYTE, STEP, mix, powers

GRAM = 80  # bytes of an anchor
RUN = 4096  # most string starts in a segment
PART = 1 << 20  # string starts of a long text that are looked at together
LISTED = 1 << 18  # most keys of repeated rows that are broadcast: 4 MB
HOT = 4096  # different segments of one anchor beyond which they are split
SPLIT = np.uint64(0xA24BAED4963EE407)


class Slice:
    """The bytes of some texts with running sums, from which any stretch's hash follows."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BACK, len(data)), out=self.sums[1:])
        self.scale = powers(STEP, len(data) + 1)

    def hashes(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        """Of the stretches, not mixed; only those of equal length compare."""
        return (self.sums[stop] - self.sums[start]) * self.scale[stop]


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: (text, place, anchor, digest).

    A string of ``length`` bytes has as anchor the least hash (by its upper half, then the
    first) among its ``GRAM``-byte grams, so equal strings have equal anchors wherever they
    stand. Runs are at most ``RUN`` long. A place holds the first start in the text, a bit that
    tells whether the anchor stands in the run more than once, so that its strings may repeat
    each other, and in 13 bits the number of starts. The digest is that of all bytes which a
    run's strings cover.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    gram = min(GRAM, length)
    whole = Slice(data)
    grams = mix(whole.hashes(slice(0, len(data) - gram + 1), slice(gram, len(data) + 1)))
    least = (grams & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(grams), dtype=np.uint64)
    span, reach = length - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor_at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    least = grams[anchor_at]
    count = np.maximum(np.diff(ends) - length + 1, 0)
    has = np.flatnonzero(count)
    first = ends[:-1][has]
    valid = np.zeros(len(least) + 1, np.int8)
    valid[first] += 1
    np.add.at(valid, first + count[has], -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    change = inside.copy()
    change[1:] &= least[1:] != least[:-1]
    change[first] = True
    start = np.flatnonzero(change)
    text = np.searchsorted(ends, start, side="right") - 1
    # empty texts share their start with the next: searchsorted gives the last, which is the one with bytes
    stop = np.minimum(np.append(start[1:], len(least)), ends[text + 1] - length + 1)
    size = stop - start
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop, text = np.repeat(start, parts) + nth * RUN, np.repeat(stop, parts), np.repeat(text, parts)
        size = np.minimum(stop - start, RUN)
    digest = mix(whole.hashes(start, start + size + length - 1) ^ (size.astype(np.uint64) * SPLIT))
    several = anchor_at[start] != anchor_at[start + size - 1]
    return text, (start - ends[text]) << 14 | several.astype(np.int64) << 13 | size, least[start].view(np.int64), digest.view(np.int64)


def bucket_pointers(data: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """For each position, a number that two positions share if and only if ``length`` equal bytes start there.

    Bucket-pointer refinement (Schürmann and Stoye, 2007) to a depth of ``length``. Positions
    are first sorted into buckets by a gram; a pointer is where a bucket begins in the sorted
    order. Buckets of more than one are refined by sorting on the pointers ``depth`` further
    on, and the new pointers serve the next round, which so sees twice as deep; buckets of
    one are done. ``stop`` is where each position's text ends; -1 marks positions too near it.
    """
    n = len(data)
    depth = max(1, length // 8)
    at = np.arange(n)
    pointer = np.full(n, -1, np.int64)
    whole = Slice(data)
    live = at[at + depth <= stop]
    key = mix(whole.hashes(live, live + depth))
    while True:
        order = np.argsort(key, kind="stable") if key.ndim == 1 else np.lexsort((key[1], key[0]))
        live = live[order]
        ordered = key[order] if key.ndim == 1 else key[:, order]
        new = np.ones(len(live), bool)
        if key.ndim == 1:
            new[1:] = ordered[1:] != ordered[:-1]
            begin = np.flatnonzero(new)
            pointer[live] = np.repeat(begin, np.diff(np.append(begin, len(live))))
        else:
            new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
            begin = np.flatnonzero(new)
            outer = np.ones(len(live), bool)
            outer[1:] = ordered[0, 1:] != ordered[0, :-1]
            since = np.arange(len(live)) - np.maximum.accumulate(np.where(outer, np.arange(len(live)), 0))
            refined = ordered[0] + since
            pointer[live] = np.repeat(refined[begin], np.diff(np.append(begin, len(live))))
        size = np.repeat(np.diff(np.append(begin, len(live))), np.diff(np.append(begin, len(live))))
        if depth >= length:
            break
        ahead = min(depth, length - depth)
        depth += ahead
        short = at[(at + depth > stop) & (pointer >= 0)]
        live = live[(size > 1) & (live + depth <= stop[live])]
        key = np.vstack([pointer[live], pointer[live + ahead]])
        held = pointer
        pointer = pointer.copy()
        pointer[short] = -1
        if depth < length:
            pointer[short] = held[short]
    pointer[at + length > stop] = -1
    return pointer


def _occurrences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, key, place) of each run."""
    for rows, data, ends in slices(batches, "text", 1 << 19):
        parts = [(0, data, ends)]
        if rows.num_rows == 1:  # a long text goes in parts that share length - 1 bytes, so that each string is in one
            parts = [(lo, data[lo : lo + PART + length - 1], np.array([0, min(PART + length - 1, len(data) - lo)])) for lo in range(0, max(len(data) - length + 1, 1), PART)]
        for lo, part, part_ends in parts:
            text, place, anchor, digest = segments(part, part_ends, length)
            key, place = rows.column(0).to_numpy()[text], place + (lo << 14)
            for at in range(0, len(key), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(x[at:to]) for x in (anchor, digest, key, place)], names=["anchor", "digest", "key", "place"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that each text is asked for."""
    for rows, data, ends in slices(batches, "text", 1 << 20):
        asked = rows.column(rows.schema.get_field_index("asked"))
        flat = asked.flatten()
        of = np.repeat(np.arange(rows.num_rows), np.diff(asked.offsets.to_numpy()))
        place = flat.field("place").to_numpy()
        start, size = ends[:-1][of] + (place >> 14), (place & 8191) + length - 1
        for at in range(0, len(of), 1 << 14):
            to = min(at + (1 << 14), len(of))
            offsets = np.concatenate([[0], np.cumsum(size[at:to])])
            found = data[np.repeat(start[at:to] - offsets[:-1], size[at:to]) + np.arange(offsets[-1])]
            column = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found)])
            part = flat.slice(at, to - at)
            key = rows.column(0).take(pa.array(of[at:to]))
            yield pa.RecordBatch.from_arrays([part.field("anchor"), part.field("salt"), part.field("hot"), part.field("twice"), key, part.field("place"), column], names=["anchor", "salt", "hot", "twice", "key", "place", "found"])


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about ``limit`` bytes that hold whole groups of (anchor, salt)."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        anchor, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(n + 1, bool)
        new[1:n] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
        new[0] = last != (anchor[0], salt[0])
        new[n] = False
        edges, last = np.flatnonzero(new), (anchor[-1], salt[-1])
        reach = utf8(batch.column(6))[1]
        at = 0
        while True:
            k = int(np.searchsorted(reach[edges], reach[at] + limit - size))
            if k == len(edges):
                break
            if edges[k] > at:
                held.append(batch.slice(at, edges[k] - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, at = [], 0, int(edges[k])
            edges = edges[k + 1 :]
        held.append(batch.slice(at))
        size += int(reach[-1] - reach[at])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Which of the segments' strings occur twice: ranges of starts; and of hot anchors a row for each other string."""
    for rows in _blocks(batches, 1 << 19):
        data, ends = utf8(rows.column(6))
        size = np.diff(ends)
        pointer = bucket_pointers(data, np.repeat(ends[1:], size), length)
        of = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(pointer >= 0)
        of, pointer = of[at], pointer[at]
        twice, hot = rows.column(3).to_numpy(zero_copy_only=False)[of], rows.column(2).to_numpy(zero_copy_only=False)[of]
        _, group, times = np.unique(pointer, return_inverse=True, return_counts=True)
        again = (times[group] > 1) & ~twice
        key, place = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        start = (place[of] >> 14) + at - ends[:-1][of]
        begin = again.copy()
        begin[1:] &= ~(again[:-1] & (of[1:] == of[:-1]))
        finish = again.copy()
        finish[:-1] &= ~(again[1:] & (of[1:] == of[:-1]))
        lo, hi, owner = start[begin], start[finish] + 1, of[begin]
        names = ["key", "lo", "hi", "string_a", "string_b", "n"]
        none = pa.nulls(len(lo), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array(lo), pa.array(hi), none, none, none], names=names)
        left = np.flatnonzero(hot)
        if len(left):
            _, one = np.unique(group[left], return_index=True)
            left = left[one]
            value = Slice(data).hashes(at[left], at[left] + length)
            settled = (times[group[left]] > 1) | twice[left]
            yield pa.RecordBatch.from_arrays([pa.array(key[of[left]]), pa.array(start[left]), pa.array(start[left] + 1), pa.array(mix(value).view(np.int64)), rows.column(0).take(pa.array(of[left])), pa.array(np.where(settled, 2, 1))], names=names)


def _remove(batches: Iterator[pa.RecordBatch], length: int, names: Sequence[str], binary: bool) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes that its repeated strings cover."""
    for rows, data, ends in slices(batches, "__text", 1 << 20):
        asked = rows.column(rows.schema.get_field_index("__ranges"))
        flat = asked.flatten()
        of = np.repeat(np.arange(rows.num_rows), np.diff(asked.offsets.to_numpy()) if not asked.null_count else np.array([len(x) if x.is_valid else 0 for x in asked]))
        edge = np.zeros(len(data) + 1, np.int32)
        if len(of):
            np.add.at(edge, ends[:-1][of] + flat.field("lo").to_numpy(), 1)
            np.add.at(edge, ends[:-1][of] + flat.field("hi").to_numpy() + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        finish = gone.copy()
        finish[:-1] &= ~gone[1:]
        inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
        begin[inner] = gone[inner]
        finish[inner - 1] = gone[inner - 1]
        lo, hi = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        text = np.searchsorted(ends, lo, side="right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(lo, ends).astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo - ends[text]), pa.array(hi - ends[text])], names=["start", "stop"]))
        kept = np.concatenate([[0], np.cumsum(~gone)])[ends]
        column = pa.BinaryArray.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~gone])])
        if not binary:
            column = pa.array([str(x.as_buffer(), "utf-8", "ignore") for x in column], pa.string())
        size = np.diff(ends)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(size), pa.array(size - np.diff(kept)), spans, column], names=[*names, "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: Sequence[str] | None = None, binary: bool = True) -> DataFrame:
    """Every text without the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Sorting all suffixes would move every byte of the corpus many times. Here a string's
    anchor, the least hash of its grams, names the bucket it belongs to, and a text's strings
    come in runs with one anchor, some 60 starts long:

    0. Rows alike in id and text are one text with a count; of those that occur again, every
       string repeats.
    1. Runs are summed up by anchor; anchors that occur once, in a run without repeats of its
       own, are done.
    2. Where all runs of an anchor are equal, all their strings repeat. Among different ones,
       those that occur twice do too.
    3. One run of each kind is brought to its anchor, and ``bucket_pointers`` sorts their
       strings. An anchor of over ``HOT`` kinds is dealt out in parts, sorted each by itself;
       what is single in its part is then counted over all parts by its digest.
    4. The ranges found are brought to their texts.

    Counts are summed before shuffles; joins are plain ones that AQE splits at hot anchors.
    Runs are compared by 128 bits of hashes. Texts are named by 64 bits over id and text;
    where another 64 bits tell texts of one name apart, they are named by these. Whole sets
    of equal runs are settled by digests (2); the refinement decides among different runs.

    Returns the columns in ``keep`` (default: id alone), n_bytes, n_removed, spans (array of
    start, stop of the maximal removed runs) and kept (binary: a cut may fall inside a
    character; without ``binary`` a string, less what a cut has left of a character). A long text's strings are looked at a part at a time; its bytes and ranges
    are one row. Null text is empty; texts shorter than ``length`` stay whole; equal rows are
    texts like others, each found in the other; null ids are allowed; an empty table gives no
    rows. Columns named as an added one are replaced by it.
    """
    added = ["n_bytes", "n_removed", "spans", "kept"]
    names = [c for c in ([id_col] if keep is None else keep) if c not in added]
    bounded_batches(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, other = (F.xxhash64(*seed, F.col(id_col).isNull(), F.col(id_col), text) for seed in ([], [F.lit(7)]))
    by_key = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(other).alias("lo"), F.max(other).alias("hi"), F.first(F.octet_length(text)).alias("size")).where("n > 1")
    repeated = checkpoint(by_key)
    clashes = [r.key for r in repeated.where("lo <> hi").select("key").collect()]  # some rows ** 2 / 2 ** 65 of them
    if clashes:
        key = F.when(key.isin(clashes), other).otherwise(key)
        by_key = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.first(F.octet_length(text)).alias("size")).where("n > 1")
        repeated = checkpoint(by_key)
    keyed = docs.select(key.alias("key"), text.alias("text"))
    again_keys = repeated.count()
    if again_keys:
        listed = F.broadcast(repeated.select("key")) if again_keys <= LISTED else repeated.select("key")
        keyed = keyed.join(listed, "key", "left_anti").unionByName(keyed.join(listed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    runs = keyed.where(F.octet_length("text") >= length).mapInArrow(lambda it: emptied(_occurrences(it, length)), "anchor bigint, digest bigint, key bigint, place bigint")
    often = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max(F.expr("place & 8192")).alias("several")).where("n > 1 or several > 0")
    repeats = written(runs.join(often.select("anchor", ((F.col("lo") != F.col("hi")) | (F.col("n") == 1)).alias("mixed")), "anchor"), "repeats")

    mixed = repeats.where("mixed")
    kinds = checkpoint(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")))
    again = mixed.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    parts = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    asked = kinds.join(parts, "anchor").select(
        F.col("one.key").alias("key"),
        F.struct(
            "anchor", F.pmod(F.xxhash64("digest"), "parts").cast("int").alias("salt"), (F.col("parts") > 1).alias("hot"), (F.col("n") > 1).alias("twice"), F.col("one.place").alias("place")
        ).alias("segment"),
    ).groupBy("key").agg(F.collect_list("segment").alias("asked"))
    fetched = keyed.join(asked, "key").mapInArrow(lambda it: emptied(_cut_out(it, length)), "anchor bigint, salt int, hot boolean, twice boolean, key bigint, place bigint, found binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refined = written(
        fetched.repartition(partitions, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(lambda it: emptied(_refine(it, length)), "key bigint, lo bigint, hi bigint, string_a bigint, string_b bigint, n bigint"),
        "refined",
    )
    single = refined.where("n is not null")
    common = single.groupBy("string_a", "string_b").agg(F.sum("n").alias("all")).where("all > 1")
    ranges = (
        repeats.where("not mixed").select("key", "place").unionByName(again.select("key", "place"))
        .select("key", F.expr("shiftright(place, 14)").alias("lo"), F.expr("shiftright(place, 14) + (place & 8191)").alias("hi"))
        .unionByName(refined.where("n is null").select("key", "lo", "hi"))
        .unionByName(single.where("n = 1").join(common, ["string_a", "string_b"]).select("key", "lo", "hi"))
        .unionByName(repeated.where(F.col("size") >= length).select("key", F.lit(0).cast("long").alias("lo"), (F.col("size") - length + 1).cast("long").alias("hi")))
        .groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("__ranges"))
    )
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    # kept columns have names of their own on the way, so that none clashes with these
    carried = [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]
    joined = docs.select(key.alias("key"), F.struct(*carried).alias("kept"), text.alias("__text")).join(ranges, "key", "left")
    joined = joined.select("kept.*", "__text", F.coalesce("__ranges", empty).alias("__ranges"))
    schema = ", ".join([*[f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, joined.schema.fields[:-2], strict=True)], f"n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept {'binary' if binary else 'string'}"])
    return joined.mapInArrow(lambda it: emptied(_remove(it, length, names, binary)), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 200 bytes."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
digests AS (SELECT row_id, list_transform(range(0, greatest(n - 199, 0)), lambda i: md5_number(substr(h, 2 * i + 1, 400))) AS d FROM docs),
starts AS MATERIALIZED (SELECT row_id, unnest(d) AS d, generate_subscripts(d, 1) - 1 AS i FROM digests),
repeated AS (SELECT row_id, i FROM starts SEMI JOIN (SELECT d FROM starts GROUP BY d HAVING count(*) > 1) USING (d)),
marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY row_id ORDER BY i) + 200, true) AS fresh FROM repeated),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY row_id ORDER BY i) AS span FROM marked),
spans AS (SELECT row_id, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY row_id, span),
pieces AS (SELECT s.row_id, s.lo, s.hi, substr(h, 2 * coalesce(lag(s.hi) OVER (PARTITION BY s.row_id ORDER BY s.lo), 0) + 1,
           2 * (s.lo - coalesce(lag(s.hi) OVER (PARTITION BY s.row_id ORDER BY s.lo), 0))) AS piece FROM spans s JOIN docs USING (row_id)),
cut AS (SELECT row_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(piece, '' ORDER BY lo) AS kept FROM pieces GROUP BY row_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (row_id)
"""
