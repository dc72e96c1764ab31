"""Language by string kernels: n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the mean over the orders p of |A_p & B_p| / sqrt(|A_p| |B_p|), where A_p
and B_p are the sets of byte p-grams of the whole texts (a blended spectrum, by presence).
Landmark texts of each language span the space that the regression works in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import emptied, slices, utf8
from .common import bounded_batches, table
from .quality_cnn import fold

ORDERS = (2, 3, 4)
PIECE = 1 << 20  # bytes whose n-grams are sorted at a time
CELLS = 1 << 21  # of a batch's presence matrix
UNKNOWN = "und"


@dataclass
class Grams:
    """Distinct n-grams by text: ``codes`` (order and bytes), ``rows`` (their texts, ascending), and ``sizes`` (texts x orders)."""

    codes: np.ndarray
    rows: np.ndarray
    sizes: np.ndarray

    def weights(self) -> np.ndarray:
        """Each n-gram's entry in the presence matrix, whose rows' products are the kernel."""
        order = (self.codes >> np.uint64(32)).astype(np.int64) - ORDERS[0]
        return 1 / np.sqrt(len(ORDERS) * self.sizes[self.rows, order])


def _keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted distinct (text, order, bytes) of the n-grams within each text, in 64 bits."""
    wide = data.astype(np.uint64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    left = ends[1:][row] - np.arange(len(data))
    code, out = wide, []
    for p in range(2, ORDERS[-1] + 1):
        if len(data) < p:
            break
        code = (code[:-1] << np.uint64(8)) | wide[p - 1 :]
        fits = left[: len(code)] >= p
        keys = np.sort((row[: len(code)][fits].astype(np.uint64) << np.uint64(35)) | np.uint64(p << 32) | code[fits])
        out.append(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def presence(data: np.ndarray, ends: np.ndarray) -> Grams:
    """The distinct n-grams of whole texts; a long text goes by pieces, whose sets are united."""
    keys = np.zeros(0, np.uint64)
    if len(ends) == 2 and len(data) > PIECE:
        for at in range(0, len(data), PIECE):
            part = data[at : at + PIECE + ORDERS[-1] - 1]
            keys = np.union1d(keys, _keys(part, np.array([0, len(part)])))
    else:
        keys = _keys(data, ends)
    rows = (keys >> np.uint64(35)).astype(np.int64)
    codes = keys & np.uint64((1 << 35) - 1)
    order = (codes >> np.uint64(32)).astype(np.int64) - ORDERS[0]
    sizes = np.bincount(rows * len(ORDERS) + order, minlength=(len(ends) - 1) * len(ORDERS)).reshape(-1, len(ORDERS))
    return Grams(codes, rows, sizes)


def products(grams: Grams, vocabulary: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The presence matrix of texts over ``vocabulary`` times ``right``, in batches of texts whose matrix has at most some ``CELLS`` cells."""
    out = np.zeros((len(grams.sizes), right.shape[1]))
    if not len(vocabulary):
        return out
    at = np.minimum(np.searchsorted(vocabulary, grams.codes), len(vocabulary) - 1)
    known = vocabulary[at] == grams.codes
    rows, columns, values = grams.rows[known], at[known], grams.weights()[known]
    batch = max(1, CELLS // len(vocabulary))
    dense = np.zeros((min(batch, len(out)), len(vocabulary)), right.dtype)
    edges = np.searchsorted(rows, np.arange(0, len(out) + batch, batch))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        here = rows[lo:hi] - k * batch, columns[lo:hi]
        dense[here] = values[lo:hi]
        out[k * batch : (k + 1) * batch] = (dense @ right)[: len(out) - k * batch]
        dense[here] = 0
    return out


@dataclass
class Model:
    """Languages, and what multiplies a text's presence matrix to give their scores: landmarks times dual weights."""

    languages: list[str]
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, grams: Grams) -> np.ndarray:
        """(texts x languages), 1 for a clear yes and -1 for a clear no.

        The kernels with all landmarks times the dual weights is one product, (X L) w = X (L w): L w
        is kept, so a text's cost doesn't grow with the landmarks.
        """
        return products(grams, self.vocabulary, self.weights) + self.shift


def ridge(among: np.ndarray, against: np.ndarray, truth: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """(dual weights, shifts) of kernel ridge regression within the landmarks' span.

    ``among`` has the landmarks' kernels, ``against`` those of all texts with them. Directions
    of the landmarks' kernel below 1e-6 of its largest are left out, as usual with Nyström features.
    """
    size, axes = np.linalg.eigh(among)
    keep = size > size[-1] * 1e-6
    whiten = axes[:, keep] / np.sqrt(size[keep])
    features = against @ whiten
    mean, level = features.mean(axis=0), truth.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + strength * len(truth) * np.eye(int(keep.sum())), centred.T @ (truth - level))
    return whiten @ solved, level - mean @ solved


def train(texts: pa.Array, languages: Sequence[str], *, landmarks: int = 64, strength: float = 1e-4) -> Model:
    """The model of texts and their languages; the first ``landmarks`` texts of each language are its landmarks."""
    names = sorted(set(languages))
    if not names:
        return Model([])
    of = np.array([names.index(x) for x in languages])
    grams = presence(*utf8(texts))
    nth = np.zeros(len(of), np.int64)
    for k in range(len(names)):
        nth[of == k] = np.arange((of == k).sum())
    chosen = np.flatnonzero(nth < landmarks)
    mine = np.isin(grams.rows, chosen)
    vocabulary = np.unique(grams.codes[mine])
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    marks[np.searchsorted(vocabulary, grams.codes[mine]), np.searchsorted(chosen, grams.rows[mine])] = grams.weights()[mine]
    against = products(grams, vocabulary, marks)
    truth = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    dual, shift = ridge(against[chosen], against, truth, strength)
    weights = np.zeros((len(vocabulary), len(names)))
    for at in range(0, len(vocabulary), 1 << 14):
        weights[at : at + (1 << 14)] = marks[at : at + (1 << 14)].astype(np.float64) @ dual
    return Model(names, vocabulary, weights, shift)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, sample: int = 600, longest: int = 1 << 13, languages: int = 256, landmarks: int = 64) -> Model:
    """A model from at most ``sample`` texts, of at most ``longest`` bytes, of each of the ``languages`` most frequent languages.

    These bounds hold at every size; the driver gets at most their product of text, typically some MB. The sample is the
    rows of the smallest hashes of id and text, found by a threshold from each language's count, so
    that a language with most of the rows is sorted nowhere. Null languages and texts without
    a letter aren't learnt from; ``usable`` may rule out more rows.
    """
    rows = docs.where(F.col(lang_col).isNotNull() if usable is None else F.col(lang_col).isNotNull() & usable)
    counted = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages)
    hashed = F.xxhash64(id_col, text_col)
    texts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("hash"), F.col(id_col).alias("id"))
    texts = texts.where((F.octet_length("text") <= longest) & has_letter(F.col("text"))).join(F.broadcast(counted), "lang")
    near = texts.where(F.col("hash").cast("double") / 2.0**63 < 2.0 * 4 * sample / F.col("count") - 1)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id", "text"))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "nth", "text").orderBy("lang", "nth").toArrow().combine_chunks()
    whole = [c.combine_chunks() if isinstance(c := picked.column(n), pa.ChunkedArray) else c for n in ("text", "lang")]
    return train(whole[0], whole[1].to_pylist(), landmarks=landmarks)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: Sequence[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text in ``lang``, and in ``score`` how clear it is, from 0 to 1.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learnt; ties go to the name that sorts first. Row-local: no shuffle, about ``PIECE`` bytes of texts
    in memory at a time; a longer text stands alone, with its distinct n-grams. An empty table gives no
    rows. ``keep`` names the columns to return besides these two (all, if not given); columns named like them are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (lang, score)]
    # by place, not by name: no column of the table can clash
    source = bounded_batches(docs).select(*[docs[f"`{c}`"] for c in kept], F.when(has_letter(docs[f"`{text_col}`"]), docs[f"`{text_col}`"]))
    source = source.toDF(*[f"c{i}" for i in range(len(kept))], "text")
    fields = [T.StructField(name, f.dataType) for name, f in zip(kept, source.schema.fields, strict=False)]
    schema = T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in slices(batches, "text", PIECE):
            n = rows.num_rows
            told = np.array(rows.column(len(kept)).is_valid()) if model.languages else np.zeros(n, bool)
            names, clear = np.full(n, UNKNOWN, object), np.zeros(n)
            if told.any():
                found = model.scores(presence(data, ends))
                best = found.argmax(axis=1)
                names[told] = np.array(model.languages, object)[best[told]]
                clear[told] = np.round(np.clip((1 + found[np.arange(n), best]) / 2, 0, 1), 9)[told]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(names, pa.string()), pa.array(clear)], names=[*kept, lang, score])

    return source.mapInArrow(lambda it: emptied(run(it)), schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt without the fold that is held out (1 of 4)."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, usable=fold("doc_id", 4) != 2)
    return predict(docs, model, keep=["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
