"""A quality classifier: a byte-level convolutional network in numpy.

Bytes become vectors of 8, filters of 8 bytes move on by 4, each filter's largest value
in a chunk of 512 bytes is kept (chunks start every 448 bytes, so they overlap and cover
the whole text), and the chunks' means and maxima over the document, with its length, go through a small
dense layer into one probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import emptied, slices, utf8
from .common import bounded_batches, table

DIMS, FILTERS, HIDDEN = 8, 32, 16
STRIDE, BLOCK, CHUNK = 4, 64, 8  # bytes a step, bytes a block, blocks a chunk
Model = dict[str, np.ndarray]


def fresh_model(seed: int = 1) -> Model:
    """Random weights."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(0.5, 256, DIMS),
        "filters": draw(0.25, 2 * STRIDE * DIMS, FILTERS),
        "shift": np.zeros(FILTERS, np.float32),
        "dense": draw(0.15, 2 * FILTERS + 1, HIDDEN),
        "dense_shift": np.zeros(HIDDEN, np.float32),
        "out": draw(0.3, HIDDEN),
        "out_shift": np.zeros(1, np.float32),
    }


def lay_out(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in blocks of their own, each between 4 or more zero bytes, so that no filter sees two; and the first block of each."""
    sizes = np.diff(ends)
    blocks = (sizes + 2 * STRIDE + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    laid = np.zeros(int(first[-1]) * BLOCK + STRIDE, np.uint8)
    if len(data):
        laid[np.repeat(first[:-1] * BLOCK + STRIDE - ends[:-1], sizes) + np.arange(len(data))] = data
    return laid, first


def responses(model: Model, laid: np.ndarray) -> np.ndarray:
    """Each filter at each step: the filter's two halves are one matrix product over quads of bytes."""
    quads = model["embed"][laid].reshape(-1, STRIDE * DIMS)
    half = STRIDE * DIMS
    both = quads @ np.hstack([model["filters"][:half], model["filters"][half:]])
    return both[:-1, :FILTERS] + both[1:, FILTERS:]


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of each chunk, and each text's first chunk."""
    blocks = np.diff(first)
    chunks = np.maximum(1, -(-(blocks - 1) // (CHUNK - 1)))
    start = np.concatenate([[0], np.cumsum(chunks)])
    nth = np.arange(start[-1]) - np.repeat(start[:-1], chunks)
    lo = np.repeat(first[:-1], chunks) + nth * (CHUNK - 1)
    return lo, np.minimum(lo + CHUNK, np.repeat(first[1:], chunks)), start


def pooled(model: Model, chunk_max: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means and maxima over each text's chunks, and the logarithm of its bytes (a short text has few steps to win in)."""
    value = np.maximum(chunk_max + model["shift"], 0)
    mean = np.add.reduceat(value, start[:-1], axis=0) / np.diff(start)[:, None]
    return np.hstack([mean, np.maximum.reduceat(value, start[:-1], axis=0), np.log2(1 + sizes[:, None]) / 8]).astype(np.float32)


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    """From a text's pooled features."""
    hidden = np.tanh(features @ model["dense"] + model["dense_shift"])
    return 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_shift"], -30, 30)))


def score_texts(model: Model, data: np.ndarray, ends: np.ndarray, piece: int = 2048) -> np.ndarray:
    """Probabilities of whole texts; memory holds ``piece`` blocks' responses at a time."""
    laid, first = lay_out(data, ends)
    block_max = np.empty((int(first[-1]), FILTERS), np.float32)
    for at in range(0, len(block_max), piece):
        to = min(at + piece, len(block_max))
        block_max[at:to] = responses(model, laid[at * BLOCK : to * BLOCK + STRIDE]).reshape(to - at, BLOCK // STRIDE, FILTERS).max(axis=1)
    lo, hi, start = chunk_bounds(first)
    chunk_max = block_max[lo]
    for k in range(1, CHUNK):
        np.maximum(chunk_max, block_max[np.minimum(lo + k, hi - 1)], out=chunk_max)
    return probability(model, pooled(model, chunk_max, start, np.diff(ends)))


def _gradients(model: Model, data: np.ndarray, ends: np.ndarray, truth: np.ndarray) -> Model:
    """Of the log loss; through a maximum it flows only into the byte window that won."""
    laid, first = lay_out(data, ends)
    per = BLOCK // STRIDE
    out = responses(model, laid)
    lo, hi, start = chunk_bounds(first)
    best = out.reshape(-1, per, FILTERS)
    arg = best.argmax(axis=1)
    block_max = np.take_along_axis(best, arg[:, None], axis=1)[:, 0]
    at_block = arg + np.arange(len(arg))[:, None] * per
    chunk_max, won = block_max[lo].copy(), at_block[lo].copy()
    for k in range(1, CHUNK):
        other = np.minimum(lo + k, hi - 1)
        more = block_max[other] > chunk_max
        chunk_max = np.where(more, block_max[other], chunk_max)
        won = np.where(more, at_block[other], won)
    features = pooled(model, chunk_max, start, np.diff(ends))
    hidden = np.tanh(features @ model["dense"] + model["dense_shift"])
    d_logit = ((1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_shift"], -30, 30)))) - truth).astype(np.float32) / len(truth)
    d_hidden = d_logit[:, None] * model["out"] * (1 - hidden**2)
    d_features = d_hidden @ model["dense"].T
    counts = np.diff(start)
    of = np.repeat(np.arange(len(truth)), counts)
    value = np.maximum(chunk_max + model["shift"], 0)
    top = value == features[of, FILTERS : 2 * FILTERS]
    d_value = d_features[of, :FILTERS] / counts[of, None] + d_features[of, FILTERS : 2 * FILTERS] * top / np.maximum(np.add.reduceat(top, start[:-1], axis=0), 1)[of]
    d_value *= value > 0
    live = np.nonzero(d_value)
    weight, window = d_value[live].astype(np.float32), laid[won[live][:, None] * STRIDE + np.arange(2 * STRIDE)]
    seen = model["embed"][window].reshape(len(weight), -1)
    d_filters = np.zeros_like(model["filters"])
    d_embed = np.zeros_like(model["embed"])
    for f in range(FILTERS):
        d_filters[:, f] = weight[live[1] == f] @ seen[live[1] == f]
    d_seen = (weight[:, None] * model["filters"].T[live[1]]).reshape(-1, DIMS)
    for k in range(DIMS):
        d_embed[:, k] = np.bincount(window.ravel(), d_seen[:, k], 256)
    return {
        "embed": d_embed,
        "filters": d_filters,
        "shift": d_value.sum(axis=0),
        "dense": features.T @ d_hidden,
        "dense_shift": d_hidden.sum(axis=0),
        "out": hidden.T @ d_logit,
        "out_shift": d_logit.sum(keepdims=True),
    }


def train(texts: pa.Array, truth: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 1) -> Model:
    """Adam over shuffled batches of whole texts; without any text of either label, the random model with the right base rate."""
    model = fresh_model(seed)
    if not len(truth):
        return model
    share = np.clip(truth.mean(), 0.01, 0.99)
    model["out_shift"][:] = np.log(share / (1 - share))
    data, ends = utf8(texts)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, steps = 0, max(1, epochs * -(-len(truth) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(truth))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            part = np.concatenate([data[ends[r] : ends[r + 1]] for r in rows])
            found = _gradients(model, part, np.concatenate([[0], np.cumsum(ends[rows + 1] - ends[rows])]), truth[rows])
            step += 1
            slow = rate * (1 - 0.9 * step / steps)
            for k, g in found.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= (slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, longest: int = 1 << 16, usable: Callable[[], Column] | None = None
) -> Model:
    """A model from at most ``sample`` labelled texts of at most ``longest`` bytes (both bounds hold at every size).

    The sample is the labelled rows with the smallest hashed ids, so that it is the same in
    every run; ``usable`` may rule out rows by the id column. Null labels and ids aren't used;
    of several labels of one id each counts. Only the sample reaches the driver: at most
    ``sample * longest`` bytes, typically some 10 MB.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable())
    picked = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("truth")).orderBy(F.xxhash64("id"), "id", "truth").limit(sample)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .where(F.octet_length("text") <= longest)
        .join(F.broadcast(picked), "id")
        .orderBy(F.xxhash64("id"), "id", "truth", F.xxhash64("text"))
        .limit(sample)
        .toArrow()
        .combine_chunks()
    )
    texts = rows.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else (pa.array([], pa.string()) if isinstance(texts, pa.ChunkedArray) else texts)
    return train(texts, rows.column("truth").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: Sequence[str] | None = None, out: str = "score") -> DataFrame:
    """``docs`` with each whole text's probability in ``out``, a double from 0 to 1.

    Row-local: no shuffle, and a bounded slice of texts in memory at a time. Null text is
    scored as empty text; an empty table gives none. ``keep`` names the columns to return
    besides ``out`` (all, if not given); a column named as ``out`` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    # by place, not by name: no column of the table can clash
    source = bounded_batches(docs).select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"]).toDF(*[f"c{i}" for i in range(len(kept))], "__text")
    fields = [T.StructField(name, f.dataType, f.nullable) for name, f in zip(kept, source.schema.fields, strict=False)]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in slices(batches, "__text"):
            found = pa.array(score_texts(model, data, ends).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names=[*kept, out])

    return source.mapInArrow(lambda it: emptied(run(it)), schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``labels.quality``, learnt without the fold that is held out (1 of 3)."""
    return fit(docs, labels, usable=lambda: fold("doc_id", 3) != 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
