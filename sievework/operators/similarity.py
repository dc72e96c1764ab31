"""K-mer containment, sketches and length-gated similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scales
from ..functions.batches import code_points
from ..functions.sequences import grams
from ..session import kept


def kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """The distinct k-mers of a column."""
    return df.select(F.explode(F.array_distinct(grams(F.col(seq), k))).alias("kmer")).distinct()


def gram_counts(df: DataFrame, row_id: str, seq: str, k: int) -> DataFrame:
    """(row_id, gram, n, all): how often each of a row's distinct grams of ``k`` letters occurs, and how many grams the row has.

    Row by row, a batch at a time: nothing is grouped across rows, so ids should be unique.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ends, _ = code_points(batch.column(1).to_pandas())
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = np.flatnonzero(np.arange(len(points)) + k <= ends[1:][row])
            if not len(start):
                continue
            letters, places = np.unique(points, return_inverse=True)
            code = np.zeros(len(start), np.int64)
            for j in range(k):
                code = np.unique(code * len(letters) + places[start + j], return_inverse=True)[1]
            kinds, sample = np.unique(code, return_index=True)
            names = pa.array(["".join(map(chr, points[i : i + k].tolist())) for i in start[sample].tolist()], pa.string())
            found, n = np.unique(row[start] * len(kinds) + code, return_counts=True)
            of = found // len(kinds)
            all_ = np.maximum(sizes - k + 1, 0)[of]
            for at in range(0, len(of), 1 << 16):
                piece = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[piece])), names.take(pa.array((found % len(kinds))[piece])), pa.array(n[piece]), pa.array(all_[piece])], names=[row_id, "gram", "n", "all"])

    return df.select(row_id, seq).mapInArrow(run, f"{row_id} {kind}, gram string, n bigint, all bigint")


FEW = 1 << 20  # hashes, or centroids' components, that are broadcast: 8 MB


PIECE = 1 << 15  # letters that are hashed at once


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` letters from each place on, in some log2(k) passes: halves are hashed, then put together."""
    letter = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part, width, factor = letter ^ (letter >> np.uint64(29)), 1, 0xD6E8FEB86659FD93
    out, done = None, 0
    while True:
        if k & width:
            out = part if out is None else out[: len(out) - width] * np.uint64(factor) + part[done:] if len(out) > width else np.zeros(0, np.uint64)
            done += width
        if width * 2 > k:
            return out
        part = part[:-width] * np.uint64(factor) + part[width:] if len(part) > width else np.zeros(0, np.uint64)
        width, factor = 2 * width, factor * factor % (1 << 64)


def _found(texts: pa.Array, k: int, asked: np.ndarray, sieve: np.ndarray) -> set[str]:
    """The grams of the texts whose hash is among those asked for."""
    out, held, size = set(), [], 0

    def search() -> None:
        letters = "".join(held)
        ends = np.cumsum([len(t) for t in held])
        hashes = gram_hashes(np.frombuffer(letters.encode("utf-32-le"), np.uint32), k)
        at = np.flatnonzero(sieve[hashes >> np.uint64(64 - len(sieve).bit_length() + 1)])
        near = np.minimum(np.searchsorted(asked, hashes[at]), len(asked) - 1)
        at = at[asked[near] == hashes[at]]
        at = at[at + k <= ends[np.searchsorted(ends, at, side="right")]]  # none across two texts
        out.update(letters[i : i + k] for i in at.tolist())

    for text in texts:
        whole = text.as_py() or ""
        for lo in range(0, max(len(whole) - k + 1, 0), PIECE):
            piece = whole[lo : lo + PIECE + k - 1]
            held.append(piece)
            size += len(piece)
            if size >= PIECE:
                search()
                held, size = [], 0
    if held:
        search()
    return out


def _hashed_grams(reference: DataFrame, ref_seq: str, k: int, asked: DataFrame) -> DataFrame:
    """The reference's grams whose hash one of ``asked`` has; these hashes go to every task."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = code_points(batch.column(0).to_pandas())[0]
            yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(points, k)[::k].view(np.int64))], names=["hash"])

    hashes = np.unique(asked.select("kmer").mapInArrow(hashed, "hash bigint").toArrow().column("hash").to_numpy().view(np.uint64))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(hashes):
            return
        bits = min(24, max(10, (64 * len(hashes)).bit_length()))
        sieve = np.zeros(1 << bits, bool)
        sieve[hashes >> np.uint64(64 - bits)] = True
        for batch in batches:
            found = sorted(_found(batch.column(0), k, hashes, sieve))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["kmer"])

    return reference.select(ref_seq).mapInArrow(searched, "kmer string")


def kmer_hits(df: DataFrame, seq: str, row_id: str, reference: DataFrame, ref_seq: str, k: int) -> DataFrame:
    """(row_id, hit_fraction): the share of k-mers, repeats counted, that the reference has; 0 for none.

    Each row's k-mers are counted before the join, and of the reference's only those asked for are
    kept: by 64-bit hash before anything moves, where the hashes asked for are counted to be
    ``FEW`` at most, and then by the k-mers themselves.
    """
    own = kept(df.select(row_id, F.explode(grams(F.col(seq), k)).alias("kmer")).groupBy(row_id, "kmer").agg(F.count("*").alias("n")))
    asked = kept(own.select("kmer").distinct())
    theirs = _hashed_grams(reference, ref_seq, k, asked) if asked.count() <= FEW else reference.select(F.explode(grams(F.col(ref_seq), k)).alias("kmer"))
    known = theirs.join(asked, "kmer", "left_semi").distinct().withColumn("hit", F.lit(1))
    found = own.join(known, "kmer", "left").groupBy(row_id).agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("hit_fraction"))
    return df.select(row_id).join(found, row_id, "left").select(row_id, F.coalesce("hit_fraction", F.lit(0.0)).alias("hit_fraction"))


def shares_kmer(df: DataFrame, seq: str, row_id: str, reference: DataFrame, ref_seq: str, k: int) -> DataFrame:
    """The ids of the rows that hold one of the reference's k-mers."""
    own = df.select(row_id, F.explode(F.array_distinct(grams(F.col(seq), k))).alias("kmer"))
    return own.join(kmers(reference, ref_seq, k), "kmer", "left_semi").select(row_id).distinct()


def sketch_keys(sequences: pd.Series, k: int = 3, buckets: int = 1 << 22) -> pd.Series:
    """A key of the four least hashes of a string's k-grams, in unsigned 64-bit arithmetic; null for null.

    A shorter string is one gram. All strings' grams are hashed together.
    """
    letters, ends, there = code_points(sequences)
    sizes, wide = np.diff(ends), letters.astype(np.uint64)
    width = np.minimum(sizes, k)
    count = np.maximum(sizes - width + 1, 1)
    first = np.cumsum(count) - count
    at = np.repeat(ends[:-1] - first, count) + np.arange(int(count.sum()))
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        more = np.flatnonzero(np.repeat(width, count) > j)
        code[more] = code[more] * np.uint64(31) + wide[at[more] + j]
    key = np.full(len(sizes), scales.SKETCH_START, np.uint64)
    for factor, mask in scales.SKETCH if len(sizes) else []:
        least = np.minimum.reduceat((code * np.uint64(factor)) ^ np.uint64(mask), first)
        key = (key ^ least) * np.uint64(scales.SKETCH_FACTOR)
    out = pd.Series((key % np.uint64(buckets)).astype(np.int64), dtype="Int64", index=sequences.index)
    return out.where(pd.Series(there, index=sequences.index))


def sketch_key():
    """``sketch_keys`` as a vectorised UDF."""
    return F.pandas_udf(lambda s: sketch_keys(s), "bigint")


def composition_vectors(sequences: pd.Series) -> pd.Series:
    """Four times the 20 letters' shares, then the 400 pairs' shares; other letters count towards the length only; null for null."""
    letters, ends, there = code_points(sequences)
    n, sizes = len(ends) - 1, np.diff(ends)
    place = np.full(128, -1, np.int64)
    place[[ord(a) for a in scales.ALPHABET]] = np.arange(20)
    codes = np.where(letters < 128, place[np.minimum(letters, 127)], -1)
    row = np.repeat(np.arange(n), sizes)
    known = codes >= 0
    one = np.bincount(row[known] * 20 + codes[known], minlength=20 * n).reshape(n, 20) * 4.0 / np.maximum(sizes, 1)[:, None]
    pair = known[:-1] & known[1:] & (row[:-1] == row[1:])
    two = np.bincount(row[:-1][pair] * 400 + codes[:-1][pair] * 20 + codes[1:][pair], minlength=400 * n).reshape(n, 400)
    both = np.hstack([one, two / np.maximum(two.sum(axis=1, keepdims=True), 1)])
    return pd.Series([v if t else None for v, t in zip(both, there.tolist(), strict=True)], dtype=object, index=sequences.index)


def composition_vector():
    """``composition_vectors`` as a vectorised UDF."""
    return F.pandas_udf(lambda s: composition_vectors(s), "array<double>")


def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (|a| + |b|): 1 for equal strings, 1 for two empty ones; null if either is null.

    The longest common subsequence is found bit-parallel (Hyyrö, 2004) in Python integers, so
    of any length.
    """

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        free = full
        for c in y:
            met = free & places.get(c, 0)
            free = ((free + met) | (free - met)) & full
        return 2 * (len(x) - free.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio():
    """``indel_ratios`` as a vectorised UDF."""
    return F.pandas_udf(lambda a, b: indel_ratios(a, b), "double")


def length_gate(threshold: float) -> float:
    """The least ratio of lengths at which two strings can be that similar."""
    return threshold / (2 - threshold)


_BITS, _PER = 16, 3  # letters' counts in 64 bits: no sum carries, and none is negative


def _tallies(seq: str) -> list[str]:
    """SQL for how often each letter of the alphabet occurs, and all others together, three counts to a number."""
    counts = [f"(length({seq}) - length(replace({seq}, '{a}', '')))" for a in scales.ALPHABET]
    counts.append(f"length(regexp_replace({seq}, '[{scales.ALPHABET}]', ''))")
    packed = [counts[i : i + _PER] for i in range(0, len(counts), _PER)]
    return [" + ".join(f"shiftleft(cast(least({c}, 65535) as bigint), {_BITS * k})" for k, c in enumerate(group)) for group in packed]


def _most_shared(n: int) -> str:
    """SQL for the letters that two rows have in common at most, whatever their order: a bound of their longest common subsequence."""
    out = []
    for i in range(n):
        for k in range(_PER):
            out.append("least({})".format(", ".join(f"shiftright({side}{i}, {_BITS * k}) & 65535" for side in ("ta", "tb"))))
    return " + ".join(out)


def _plan(threshold: float) -> dict[str, str]:
    """SQL for a pair of lengths (la, lb): letters that must match, edits left, segments of b, and how many edits the best of them has.

    Of D + 1 segments one has no edit; of D div 2 + 1 one has at most one. Where such segments
    would be too short to tell anything, there are none (0): all pairs of these lengths meet.
    """
    need = f"(cast(floor({threshold!r}D * (la + lb) / 2 - 1e-9) as int) + 1)"
    return {
        "need": need,
        "edits": "la + lb - 2 * need",
        "segments": "case when lb div (edits + 1) >= 3 then edits + 1 when lb div (edits div 2 + 1) >= 4 then edits div 2 + 1 else 0 end",
        "loose": "segments <= edits",
    }


_SEGMENTS = "transform(sequence(0, segments - 1), i -> named_struct('i', i, 'p', i * lb div segments, 'w', (i + 1) * lb div segments - i * lb div segments))"
_SHORTER = "transform(sequence(1, length({x})), d -> concat({tag}, substr({x}, 1, d - 1), substr({x}, d + 1)))"
_OF_B = (
    f"flatten(transform({_SEGMENTS}, s -> concat(array(concat(s.i, '=', substr(seq_b, s.p + 1, s.w))), "
    "if(loose, {}, array()))))"
).format(_SHORTER.format(x="substr(seq_b, s.p + 1, s.w)", tag="s.i, '-'"))
_PLACES = "filter(sequence(greatest(0, s.p - (lb - need)), least(la, s.p + la - need)), q -> q + s.w - 1 <= la)"
_OF_A = (
    f"flatten(transform({_SEGMENTS}, s -> flatten(transform({_PLACES}, q -> concat("
    "if(q + s.w <= la, array(concat(s.i, '=', substr(seq_a, q + 1, s.w))), array()), "
    "if(loose, array(concat(s.i, '-', substr(seq_a, q + 1, s.w - 1))), array()), "
    "if(loose and q + s.w + 1 <= la, {}, array()))))))"
).format(_SHORTER.format(x="substr(seq_a, q + 1, s.w + 1)", tag="s.i, '='"))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, seq_a, seq_b) of all pairs that may be more alike than ``threshold``, from (a, seq_a) and (b, seq_b) with unique ids.

    A pair that is has ``need`` letters in common, so its D = la + lb - 2 need edits leave one of D + 1
    segments of b whole, or one of D div 2 + 1 with at most one letter dropped or added; a has that
    segment within as many places as letters may go missing before it. So a row of b goes to its
    segments (and these less one letter), a row of a to its windows there, and rows meet on
    equal strings. Pairs whose letters, order aside, can't have ``need`` in common are dropped in the join.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    gate = length_gate(threshold)
    tallies = len(_tallies("x"))

    def keyed(df: DataFrame, row_id: str, seq: str, own: str, other: str, side: str, keys: str) -> DataFrame:
        lengths = f"sequence(cast(ceil({own} * {gate!r}D - 1e-9) as int), cast(floor({own} / {gate!r}D + 1e-9) as int))"
        out = df.select(row_id, seq, F.length(seq).alias(own), *[F.expr(t).alias(f"{side}{i}") for i, t in enumerate(_tallies(seq))])
        out = out.withColumn(other, F.explode(F.expr(lengths)))
        for name, value in _plan(threshold).items():
            out = out.withColumn(name, F.expr(value))
        out = out.where("need <= least(la, lb)")
        return out.withColumn("key", F.explode(F.expr(f"if(segments > 0, array_distinct({keys}), array(''))"))).select(row_id, seq, "la", "lb", "key", "need", *[f"{side}{i}" for i in range(tallies)])

    a, b = keyed(left, "a", "seq_a", "la", "lb", "ta", _OF_A), keyed(right, "b", "seq_b", "lb", "la", "tb", _OF_B).drop("need")
    met = a.join(b, ["la", "lb", "key"]).where(f"la > 65535 or lb > 65535 or {_most_shared(tallies)} >= need")
    return met.select("a", "b", "seq_a", "seq_b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) of the pairs above ``threshold``, from (a, seq_a) and (b, seq_b) with unique ids: exact, whatever ``candidate_pairs`` spares."""
    met = candidate_pairs(left, right, threshold)
    return met.select("a", "b", indel_ratio()("seq_a", "seq_b").alias("ratio")).where(F.col("ratio") > threshold)


def nearest(df: DataFrame, centroids: DataFrame, cell: str | None = None) -> DataFrame:
    """(row_id, sub, dist2) of the nearest centroid by squared distance, the smaller number first on ties.

    ``df`` has (row_id, vector), ``centroids`` (sub, centroid), both with ``cell`` where one
    is named; a row whose cell has no centroid gets -1. Without a cell, the centroids are
    broadcast where they are counted to have ``FEW`` components at most.
    """
    gaps = F.zip_with("vector", "centroid", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    dist = F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x)
    on = [cell] if cell else []
    if on:
        joined = df.join(centroids, on, "left")
    else:
        size = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
        joined = df.crossJoin(F.broadcast(centroids) if size <= FEW else centroids)
    return joined.withColumn("dist2", dist).groupBy("row_id").agg(F.min(F.struct("dist2", "sub")).alias("best")).select("row_id", F.coalesce("best.sub", F.lit(-1)).alias("sub"), "best.dist2")
