"""A gated recurrent language model in numpy with a class-factored softmax, trained on all documents.

The most frequent words, one for every 512 distinct ones of the training texts, have a vector
and an output each; these head words sit in classes of equal frequency, as many as 0.6 times
the square root of their number. All other words belong to classes by their first two bytes; within such a class a word's probability is its
add-one share of the class's training tokens, with one type kept for words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied, slices
from .common import bounded_batches, most_frequent, table, written
from .quality_cnn import fold
from .shingles import LOWER, mix, span_hashes, word_spans

HIDDEN = 32
HEAD, HEAD_CLASSES, TAIL_CLASSES = 2048, 32, 64  # least room for head words and their classes
PER_HEAD = 512  # distinct training words for each head word beyond these
LISTED = 1 << 18  # most frequent words whose counts every task has: 5 MB
WIDTH = 16  # replicas of the network that a task of the averaging tree reads, on average
END = np.uint64(0x51ED270B9F6A3C2D)  # stands for the end of a text
STREAMS, STEPS = 512, 16
STRETCH = 4096  # tokens after which learning starts a text anew; scoring never does
TOKENS = 4 << 20  # tokens that a task holds at a time
ONES = np.ones(1 << 18, np.float32)  # no fewer than the listed words or a window's tokens
SMALL = 1_000_000  # multiplications of a product of matrices that OpenBLAS makes without packing them first, up to twice as fast
LOGITS = 1 << 17  # logits of words that are exponentiated at a time: 512 KB, which stay in the cache
LONG = 12  # occurrences of a word in a window from which they are summed by a product
STEP = 8192  # weights that the optimiser changes at a time
MOST, LEAST = np.full(STEP, 0.1, np.float32), np.full(STEP, -0.1, np.float32)  # of a weight's slope by token
Model = dict[str, np.ndarray]


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, their tail classes, n + 1 offsets)."""
    first, last = word_spans(data, ends)
    words, at = span_hashes(data, first, last), np.searchsorted(first, ends)
    if len(first):
        second = LOWER[data[np.minimum(first + 1, last)]].astype(np.uint64) * (last > first)
        kind = (mix(LOWER[data[first]].astype(np.uint64) << np.uint64(8) | second) % np.uint64(TAIL_CLASSES)).astype(np.int32)
    else:
        kind = np.zeros(0, np.int32)
    return np.insert(words, at[1:], END), np.insert(kind, at[1:], 0), at + np.arange(len(at))


class Vocabulary:
    """Counts of the listed words, which are head words, and sums of the tail classes; picklable and of bounded size."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_types: np.ndarray) -> None:
        """``hashes`` and so on by count, largest first; the class sums are over all training words."""
        head = min(max(HEAD, int(class_types.sum()) // PER_HEAD), int((counts >= 5).sum()))
        self.room, self.classes = max(HEAD, head), max(HEAD_CLASSES, int(0.6 * np.sqrt(head)))
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.head_id = np.where(order < head, order, -1).astype(np.int32)
        mass = counts[:head].cumsum() / max(counts[:head].sum(), 1)
        group = np.minimum((mass - counts[:head] / max(counts[:head].sum(), 1)) * self.classes, self.classes - 1).astype(int)
        self.word_class = np.searchsorted(np.unique(group), group)
        self.bounds = np.searchsorted(self.word_class, np.arange(self.classes + 1)).tolist()
        self.class_of = np.concatenate([self.word_class, np.zeros(self.room - head, int), self.classes + np.arange(TAIL_CLASSES)]).astype(np.int16)
        self.head = head
        self.tables: list[tuple[int, np.ndarray]] = []
        rest_tokens, rest_types = class_tokens.astype(np.int64).copy(), class_types.astype(np.int64).copy()
        np.subtract.at(rest_tokens, kinds[:head], counts[:head])
        np.subtract.at(rest_types, kinds[:head], 1)
        self.tail_total = np.log10(rest_tokens + rest_types + 1.0)
        self.train_tokens, self.train_types = int(class_tokens.sum()), int(class_types.sum())

    def place(self, words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(head id, or ``room`` + tail class; count, or -1 where it isn't listed)."""
        at = self.find(words)
        head = np.where(at >= 0, self.head_id[at] if len(self.head_id) else -1, -1)
        return np.where(head >= 0, head, self.room + kinds).astype(np.int32), np.where(at >= 0, self.counts[at] if len(self.counts) else -1, -1)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the listed ones, or -1: hash tables, each for those that had no room in the ones before."""
        if not self.tables:
            left = np.arange(len(self.hashes))
            while len(left):
                bits = max(1, int(4 * len(left)).bit_length())
                slot = self._slot(self.hashes[left], len(self.tables), bits)
                table_ = np.full(1 << bits, -1, np.int32)
                table_[slot[::-1]] = left[::-1]
                left = left[table_[slot] != left]
                self.tables.append((bits, table_))
        found = np.full(len(words), -1, np.int32)
        at: np.ndarray | slice = slice(None)
        for k, (bits, table_) in enumerate(self.tables):
            own = words[at]
            place = table_[self._slot(own, k, bits)]
            hit = (place >= 0) & (self.hashes[place] == own)
            found[at] = np.where(hit, place, -1)
            at = np.flatnonzero(~hit) if k == 0 else at[~hit]
        return found

    @staticmethod
    def _slot(words: np.ndarray, k: int, bits: int) -> np.ndarray:
        return ((mix(words + np.uint64(k)) if k else words) >> np.uint64(64 - bits)).astype(np.int64)


def fresh_model(vocabulary: Vocabulary, seed: int = 3) -> Model:
    """Random weights; output shifts start at the training frequencies."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    room, classes = vocabulary.room, vocabulary.classes + TAIL_CLASSES
    by_class = np.full(classes, 0.5)
    by_word = np.zeros(room)
    counts = np.zeros(room)
    listed = vocabulary.head_id >= 0
    counts[vocabulary.head_id[listed]] = vocabulary.counts[listed]
    np.add.at(by_class, vocabulary.word_class, counts[: vocabulary.head])
    by_class[vocabulary.classes :] += 10**vocabulary.tail_total - 1
    by_word[: vocabulary.head] = np.log(counts[: vocabulary.head])
    return {
        "embed": draw(0.3, room + TAIL_CLASSES, HIDDEN),
        "input": draw(0.15, HIDDEN, 3 * HIDDEN),
        "recur": draw(0.12, HIDDEN, 3 * HIDDEN),
        "shift": np.concatenate([np.full(HIDDEN, -0.5), np.zeros(2 * HIDDEN)]).astype(np.float32),
        "class": draw(0.05, HIDDEN, classes),
        "class_shift": np.log(by_class / by_class.sum()).astype(np.float32),
        "word": draw(0.05, room, HIDDEN),
        "word_shift": by_word.astype(np.float32),
    }


def _in_thirds(weights: np.ndarray) -> np.ndarray:
    """(3, rows, HIDDEN): what the update gate, the reset gate and the fresh state take; the gates' halved.

    The logistic function of x is (1 + tanh(x / 2)) / 2; and thirds that lie apart are
    contiguous in all that follows.
    """
    out = np.ascontiguousarray(weights.reshape(-1, 3, HIDDEN).swapaxes(0, 1))
    out[:2] *= 0.5
    return out


def _forward(recur: np.ndarray, inputs: np.ndarray, state: np.ndarray, begins: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The states before each of the steps, and after the last: (steps + 1, streams, HIDDEN).

    A text that ``begins`` at a step has a state of zeros there. ``recur`` and ``inputs``,
    (3, steps, streams, HIDDEN), are ``_in_thirds``; ``inputs`` become the gates and the fresh
    states. With ``keep`` what the reset gate is multiplied with is returned too.
    """
    steps = inputs.shape[1]
    states = np.empty((steps + 1, *state.shape), np.float32)
    states[0] = state
    mine, reset = np.empty((3, *state.shape), np.float32), np.empty_like(state)
    kept = np.empty((steps, *state.shape), np.float32) if keep else None
    some = begins.any(axis=1).tolist()
    for t in range(steps):
        now, gates, fresh, step = states[t], inputs[:2, t], inputs[2, t], states[t + 1]
        if some[t]:
            now[begins[t]] = 0
        np.matmul(now, recur, out=mine)
        gates += mine[:2]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[1], mine[2], out=reset)
        fresh += reset
        np.tanh(fresh, out=fresh)
        np.subtract(fresh, now, out=step)
        step *= gates[0]
        step += now
        if kept is not None:
            kept[t] = mine[2]
    return states, kept


def _blocks(n: int, most: int) -> list[slice]:
    """Slices of ``n`` places, of at most ``most`` each, of about equal length: a multiple of 16 if that can be."""
    size = -(-n // -(-n // max(most, 1)))
    size = min(-(-size // 16) * 16, max(most // 16 * 16, size))
    return [slice(at, min(at + size, n)) for at in range(0, n, size)]


def _output_tables(model: Model) -> tuple[np.ndarray, np.ndarray, bool]:
    """(the vectors of all classes, those of all head words, a column each, with their shifts as the last row; whether no state, whose components are in -1 to 1, has a logit beyond 60)."""
    words = np.empty((HIDDEN + 1, len(model["word"])), np.float32)
    words[:HIDDEN], words[HIDDEN] = model["word"].T, model["word_shift"]
    classes = np.vstack([model["class"], model["class_shift"]])
    most = (np.sqrt(HIDDEN * np.einsum("ij,ij->j", x[:HIDDEN], x[:HIDDEN])) + np.abs(x[HIDDEN]) for x in (classes, words))
    return classes, words, all(x.max() < 60 for x in most)


def _weighed(own: np.ndarray, table_: np.ndarray, of: np.ndarray, room: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit of column ``of`` in each row, all exponentials, their row sums, places of ``of`` among them laid flat).

    Logits and sums are less the row's largest where they may overflow. ``room`` is where the
    exponentials are; it is used again and so stays in the cache.
    """
    rows, width = len(own), table_.shape[1]
    flat, place = room[: rows * width], np.arange(0, rows * width, width)
    logits = flat.reshape(rows, width)
    place += of
    for part in _blocks(width, SMALL // own.size):
        np.matmul(own, table_[:, part], out=logits[:, part])
    if not bounded and flat.max() > 60:
        logits -= logits.max(axis=1)[:, None]
    mine = flat[place]
    np.exp(flat, out=flat)
    return mine, logits, logits @ ONES[:width], place


def _slopes(weight: np.ndarray, total: np.ndarray, place: np.ndarray, own: np.ndarray, by_table: np.ndarray, to_state: np.ndarray, out: np.ndarray) -> None:
    """From what ``_weighed`` found, the loss's gradients: that by row is added to ``out``, that by column to ``by_table``."""
    weight *= (1 / total)[:, None]
    weight.reshape(-1)[place] -= 1
    for part in _blocks(len(to_state), SMALL // own.size):
        by_table[part] += weight[:, part].T @ own
    for part in _blocks(len(own), SMALL // to_state.size):
        out[part] += weight[part] @ to_state


def _log_likelihoods(model: Model, vocabulary: Vocabulary, states: np.ndarray, ids: np.ndarray, grads: Model | None = None, tables: tuple[np.ndarray, np.ndarray, bool] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln of each token's class and, for head words, of the word in it; with ``grads``, which are filled, the loss's gradient by state too.

    Tokens are put in order of their classes, so that each class is one stretch. States get a
    last component of one, which takes the shifts. Products are of blocks that stay in the cache.
    """
    n, learns = len(ids), grads is not None
    kind = vocabulary.class_of[ids]
    order = np.argsort(kind, kind="stable")
    kind, ids = kind[order].astype(np.int64), ids[order].astype(np.int64)
    own = np.ones((n, HIDDEN + 1), np.float32)
    own[:, :HIDDEN] = np.take(states, order, axis=0)
    classes, words, bounded = tables or _output_tables(model)
    out, total, word_total = np.empty(n, np.float32), np.empty(n, np.float32), np.ones(n, np.float32)
    if learns:
        d_states, by_class, by_word = np.zeros((n, HIDDEN), np.float32), np.zeros(classes.shape[::-1], np.float32), np.zeros(words.shape[::-1], np.float32)
        to_state = np.ascontiguousarray(model["class"].T)
    word, bounds, edges = model["word"], vocabulary.bounds, np.searchsorted(kind, np.arange(vocabulary.classes + 1)).tolist()
    height = max(SMALL // classes.size // 32 * 32, 32)
    room = np.empty(max(height * classes.shape[1], LOGITS, words.shape[1]), np.float32)
    for at in range(0, n, height):
        part = slice(at, at + height)
        out[part], weight, total[part], place = _weighed(own[part], classes, kind[part], room, bounded)
        if learns:
            _slopes(weight, total[part], place, own[part], by_class, to_state, d_states[part])
    for c in range(vocabulary.classes):
        lo, hi = bounds[c], bounds[c + 1]
        if hi - lo < 2:
            continue
        height = LOGITS // (hi - lo) or 1
        for at in range(edges[c], edges[c + 1], height):
            part = slice(at, min(at + height, edges[c + 1]))
            mine, weight, word_total[part], place = _weighed(own[part], words[:, lo:hi], ids[part] - lo, room, bounded)
            out[part] += mine
            if learns:
                _slopes(weight, word_total[part], place, own[part], by_word[lo:hi], word[lo:hi], d_states[part])
    out -= np.log(total)
    out -= np.log(word_total)
    back = np.empty_like(order)
    back[order] = np.arange(n)
    if not learns:
        return out[back], None
    grads["class"][:], grads["class_shift"][:] = by_class[:, :HIDDEN].T, by_class[:, HIDDEN]
    grads["word"][:], grads["word_shift"][:] = by_word[:, :HIDDEN], by_word[:, HIDDEN]
    return out[back], np.take(d_states, back, axis=0)


def _sums(which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values of ``which``, the sums of their rows)."""
    order = np.argsort(which, kind="stable")
    which, rows = which[order], np.take(rows, order, axis=0)
    begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    times = np.diff(begin, append=len(which))
    begin, times = (x[np.argsort(-times, kind="stable")] for x in (begin, times))
    out = np.take(rows, begin, axis=0)
    many = int(np.searchsorted(-times, -LONG, side="right"))
    for i, (at, n) in enumerate(zip(begin[:many].tolist(), times[:many].tolist(), strict=True)):
        out[i] = ONES[:n] @ rows[at : at + n]
    for k in range(1, LONG):
        to = int(np.searchsorted(-times, -k))
        out[many:to] += np.take(rows, begin[many:to] + k, axis=0)
    return which[begin], out


def _windows(ends: np.ndarray, steps: int, seed: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows over streams of texts laid end to end: (places of the tokens, (steps, streams); mask; where texts begin).

    Texts go, longest first, to the least loaded of ``STREAMS`` streams, and stand there in that
    order, or a random one by ``seed``. Streams go longest first, so that those that still run
    are always the first ones; where few do, a window of scoring is longer.
    """
    sizes = np.diff(ends)
    count = min(STREAMS, len(sizes))
    loads = [(0, k) for k in range(count)]
    heapify(loads)
    order, stream = np.argsort(-sizes, kind="stable"), np.zeros(len(sizes), np.int64)
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        load, k = loads[0]
        stream[i] = k
        heapreplace(loads, (load + n, k))
    key = -sizes if seed is None else np.random.default_rng(seed).permutation(len(sizes))
    totals = np.bincount(stream, sizes, count).astype(np.int64)
    rank = np.argsort(np.argsort(-totals, kind="stable"), kind="stable")
    totals = np.sort(totals)[::-1]
    seq = np.lexsort((key, rank[stream]))
    first = np.cumsum(sizes[seq]) - sizes[seq]
    at = np.repeat(ends[seq] - first, sizes[seq]) + np.arange(int(sizes.sum()))
    begins = np.zeros(len(at), bool)
    begins[first] = True
    start = np.cumsum(totals) - totals
    lo = 0
    while count and lo < totals[0]:
        live = int(np.searchsorted(-totals, -lo, side="left"))
        width = int(min(steps if seed is not None else max(steps, min(STREAMS * steps // live, STRETCH)), totals[0] - lo))
        place = lo + np.arange(width)[:, None]
        mask = place < totals[:live]
        where = start[:live] + np.minimum(place, totals[:live] - 1)
        yield at[where], mask, begins[where] & mask
        lo += width


def score_tokens(model: Model, vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 of each text's classes and head words, the state carried from window to window to its end."""
    found = np.zeros(len(ends) - 1)
    of = np.repeat(np.arange(len(found)), np.diff(ends))
    ready, recur = _in_thirds((model["embed"] @ model["input"] + model["shift"]).astype(np.float32)), _in_thirds(model["recur"])
    state, tables = np.zeros((STREAMS, HIDDEN), np.float32), _output_tables(model)
    for at, mask, begins in _windows(ends, STEPS):
        window = ids[at]
        states, _ = _forward(recur, np.take(ready, window, axis=1), state[: window.shape[1]], begins)
        state = states[-1]
        whole = bool(mask.all())
        part, _ = _log_likelihoods(model, vocabulary, states[:-1].reshape(-1, HIDDEN) if whole else states[:-1][mask], window.ravel() if whole else window[mask], tables=tables)
        found += np.bincount(of[at.ravel() if whole else at[mask]], part, len(found))
    return found / np.log(10)


class Trainer:
    """Adam over windows of ``STEPS`` tokens of ``STREAMS`` texts; gradients stop at a window's start, states don't.

    The weights but for the vectors lie in one array, which the optimiser goes through in
    blocks that stay in the cache; of the vectors, those of a window's words are changed.
    """

    def __init__(self, model: Model, vocabulary: Vocabulary, rate: float) -> None:
        self.vocabulary, self.rate, self.step = vocabulary, rate, 0
        dense = [k for k in sorted(model) if k != "embed"]
        self.flat = np.concatenate([model[k].ravel() for k in dense]).astype(np.float32)
        self.slope = np.zeros_like(self.flat)
        self.model, self.grads = {"embed": model["embed"].copy()}, {}
        at = 0
        for k in dense:
            to = at + model[k].size
            self.model[k], self.grads[k] = self.flat[at:to].reshape(model[k].shape), self.slope[at:to].reshape(model[k].shape)
            at = to
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.first_embed, self.second_embed = np.zeros_like(model["embed"]), np.zeros_like(model["embed"])

    def learn(self, ids: np.ndarray, ends: np.ndarray, seed: int = 0) -> None:
        """One pass over some texts, in stretches of ``STRETCH`` tokens."""
        pieces = -(-np.diff(ends) // STRETCH)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = np.append(np.repeat(ends[:-1], pieces) + nth * STRETCH, ends[-1])
        state = np.zeros((STREAMS, HIDDEN), np.float32)
        for at, mask, begins in _windows(cut, STEPS, seed):
            state = self._window(ids[at], mask, begins, state[: at.shape[1]])

    def _window(self, window: np.ndarray, mask: np.ndarray, begins: np.ndarray, state: np.ndarray) -> np.ndarray:
        model, grads, h = self.model, self.grads, HIDDEN
        seen = np.take(model["embed"], window, axis=0)
        recur, taken, shift = _in_thirds(model["recur"]), _in_thirds(model["input"]), _in_thirds(model["shift"])
        inputs = np.matmul(seen, taken[:, None])
        inputs += shift[:, None]
        states, mine = _forward(recur, inputs, state, begins, keep=True)
        n, whole = max(int(mask.sum()), 1), bool(mask.all())
        before = states[:-1]
        _, d_out = _log_likelihoods(model, self.vocabulary, before.reshape(-1, h) if whole else before[mask], window.ravel() if whole else window[mask], grads)
        if whole:
            by_state = d_out.reshape(before.shape)
        else:
            by_state = np.zeros_like(before)
            by_state[mask] = d_out
        slopes, to_fresh = np.empty_like(inputs), np.empty_like(mine)
        spread, stay, taking = np.empty((3, *state.shape), np.float32), np.empty_like(state), np.empty_like(state)
        recur[:2] *= 2
        taken[:2] *= 2
        back, d_state = np.ascontiguousarray(recur.swapaxes(1, 2)), np.zeros_like(state)
        for t in range(len(window) - 1, -1, -1):
            z, r, fresh = inputs[:, t]
            by_z, by_r, by_fresh = slopes[:, t]
            np.subtract(1, z, out=stay)
            np.multiply(z, d_state, out=taking)
            np.subtract(fresh, before[t], out=by_z)
            by_z *= stay
            by_z *= taking
            np.multiply(fresh, fresh, out=by_fresh)
            np.subtract(1, by_fresh, out=by_fresh)
            by_fresh *= taking
            np.multiply(by_fresh, r, out=to_fresh[t])
            np.subtract(1, r, out=by_r)
            by_r *= mine[t]
            by_r *= to_fresh[t]
            np.matmul(slopes[:2, t], back[:2], out=spread[:2])
            np.matmul(to_fresh[t], back[2], out=spread[2])
            d_state *= stay
            d_state += spread[0]
            d_state += spread[1]
            d_state += spread[2]
            d_state += by_state[t]
            d_state[begins[t]] = 0
        past, entered, leave, d_seen = before.swapaxes(1, 2), seen.swapaxes(1, 2), np.ascontiguousarray(taken.swapaxes(1, 2)), np.zeros_like(seen)
        for k in range(3):
            part = slice(k * h, k * h + h)
            grads["recur"][:, part] = np.matmul(past, slopes[k] if k < 2 else to_fresh).sum(axis=0)
            grads["input"][:, part] = np.matmul(entered, slopes[k]).sum(axis=0)
            grads["shift"][part] = ONES[: window.size] @ slopes[k].reshape(-1, h)
            d_seen += np.matmul(slopes[k], leave[k])
        words, by_word = _sums(window.ravel().astype(np.uint16 if len(model["embed"]) <= 1 << 16 else np.int32), d_seen.reshape(-1, h))
        self._adam(words, by_word, n)
        return states[-1]

    def _adam(self, words: np.ndarray, by_word: np.ndarray, n: int) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for at in range(0, len(self.flat), STEP):
            part = slice(at, at + STEP)
            _adam_step(self.flat[part], self.slope[part], self.first[part], self.second[part], scale, n)
        weight, first, second = (np.take(x, words, axis=0) for x in (self.model["embed"], self.first_embed, self.second_embed))
        _adam_step(weight, by_word, first, second, scale, n)
        self.model["embed"][words], self.first_embed[words], self.second_embed[words] = weight, first, second


def _adam_step(weight: np.ndarray, slope: np.ndarray, first: np.ndarray, second: np.ndarray, scale: float, n: int) -> None:
    """One step in place, with the slopes divided by ``n`` and clipped; ``slope`` is overwritten.

    ``first`` and ``second`` are ten and a hundred times the means of slopes and their squares,
    by which the step's ratio stays the same, with 1e-6 made ten times as large.
    """
    slope *= np.float32(1 / n)
    if weight.ndim == 1:
        np.minimum(slope, MOST[: len(slope)], out=slope)
        np.maximum(slope, LEAST[: len(slope)], out=slope)
    else:
        np.clip(slope, -0.1, 0.1, out=slope)
    first *= np.float32(0.9)
    first += slope
    second *= np.float32(0.99)
    slope *= slope
    second += slope
    np.sqrt(second, out=slope)
    slope += np.float32(1e-5)
    np.divide(first, slope, out=slope)
    slope *= np.float32(scale)
    weight -= slope


def pack_model(model: Model) -> bytes:
    """All weights as bytes, in the order of their names."""
    return b"".join(model[k].astype(np.float32).tobytes() for k in sorted(model))


def unpack_model(data: bytes, like: Model) -> Model:
    """The inverse of ``pack_model``."""
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _held(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first column, ids, counts, hashes, offsets) of some ``TOKENS`` tokens at a time."""
    held: list[tuple] = []
    waiting = 0
    for rows, data, ends in slices(batches, "text", 4 << 20):
        words, kinds, at = tokens(data, ends)
        held.append((rows.column(0), *vocabulary.place(words, kinds), words, at))
        waiting += len(words)
        if waiting >= TOKENS:
            yield _joined(held)
            held, waiting = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    sizes = np.concatenate([np.diff(x[4]) for x in held])
    return pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)), np.concatenate([[0], np.cumsum(sizes)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, ends in slices(batches, "text"):
        words, kinds, _ = tokens(data, ends)
        coded = pa.array(words.view(np.int64)).dictionary_encode()
        of, value = coded.indices.to_numpy(), coded.dictionary
        kind = np.zeros(len(value), np.int32)
        kind[of] = kinds
        yield pa.RecordBatch.from_arrays([value, pa.array(kind), pa.array(np.bincount(of, minlength=len(value)))], names=["word", "kind", "n"])


def _train(batches: Iterator[pa.RecordBatch], model: Model, vocabulary: Vocabulary, rate: float, passes: int) -> Iterator[pa.RecordBatch]:
    trainer, seen = Trainer(model, vocabulary, rate), 0
    for _, ids, _, _, ends in _held(batches, vocabulary):
        for k in range(passes):
            trainer.learn(ids, ends, k)
        seen += len(ids)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([pack_model(trainer.model)])], names=["weight", "model"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0.0
    for batch in batches:
        for w, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(data.as_buffer(), np.float32) * w
            total, weight = own if total is None else total + own, weight + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()])], names=["weight", "model"])


def _averaged(replicas: DataFrame) -> list:
    """The one row (weight, model) of all replicas' mean by weight, none if there are none: a tree in which a task reads the replicas of about ``WIDTH`` others, one at a time, as deep as it needs to be."""
    parts = replicas.rdd.getNumPartitions()
    while True:
        parts = -(-parts // WIDTH)
        replicas = replicas.repartition(max(1, parts)).mapInArrow(lambda it: emptied(_average(it)), "weight double, model binary")
        if parts <= 1:
            return replicas.collect()


def learn(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", start: int = 600, rate: float = 0.004) -> tuple[Model, Vocabulary, DataFrame]:
    """(model, vocabulary, all training words with their counts) from all of ``docs``.

    Word counts cover every text. The network starts from ``start`` texts (the smallest
    hashed ids), learnt in one task; then every task of one pass over all texts goes on from
    there with its own, and the weights are averaged by tokens in a tree (``_averaged``).
    """
    source = bounded_batches(docs).select(F.col(text_col).alias("text"))
    words = written(source.mapInArrow(lambda it: emptied(_count(it)), "word bigint, kind int, n bigint").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "words")
    top = most_frequent(words, LISTED).toPandas().sort_values(["n", "word"], ascending=[False, True])
    sums = words.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    class_tokens, class_types = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    class_tokens[sums["kind"].to_numpy()], class_types[sums["kind"].to_numpy()] = sums["n"].to_numpy(), sums["types"].to_numpy()
    vocabulary = Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["kind"].to_numpy(np.int64), top["n"].to_numpy(np.int64), class_tokens, class_types)
    model = fresh_model(vocabulary)
    shape = "weight double, model binary"
    seeds = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id")).where(F.octet_length("text") < 20_000).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(start).select("text")
    for frame, passes, speed in ((seeds.coalesce(1), 6, rate), (source, 1, rate / 2)):
        replicas = frame.mapInArrow(lambda it, m=model, p=passes, r=speed: emptied(_train(it, m, vocabulary, r, p)), shape)
        merged = _averaged(replicas)
        if merged:
            model = unpack_model(merged[0]["model"], model)
    return model, vocabulary, words


def _score(batches: Iterator[pa.RecordBatch], model: Model, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for names, ids, counts, words, ends in _held(batches, vocabulary):
        n = len(ends) - 1
        of = np.repeat(np.arange(n), np.diff(ends))
        partial = score_tokens(model, vocabulary, ids, ends)
        tail = ids >= vocabulary.room
        partial -= np.bincount(of[tail], vocabulary.tail_total[ids[tail] - vocabulary.room], n)
        listed = counts >= 0
        own = np.log10(np.maximum(counts, 0) + 1.0)
        partial += np.bincount(of[tail & listed], own[tail & listed], n)
        base = np.bincount(of[listed], own[listed], n)
        known = np.bincount(of[listed & (counts > 0)], minlength=n)
        at = np.flatnonzero(~listed)
        at = at[np.lexsort((words[at], of[at]))]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (words[at][1:] != words[at][:-1]) | (of[at][1:] != of[at][:-1])
        begin = np.flatnonzero(fresh)
        times = np.diff(np.append(begin, len(at)))
        at = at[begin]
        offsets = np.searchsorted(of[at], np.arange(n + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(words[at].view(np.int64)), pa.array(times)], names=["word", "times"]))
        for lo in range(0, n, 4096):
            part = slice(lo, min(lo + 4096, n))
            yield pa.RecordBatch.from_arrays([names[part], *(pa.array(x[part]) for x in (np.diff(ends), known, base, partial)), others[part]], names=["id", "n_tokens", "n_known", "base", "partial", "others"])


def score(docs: DataFrame, model: Model, vocabulary: Vocabulary, words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text).

    Counts of the ``LISTED`` most frequent words are at hand in every task; each text's other
    words, which are rare, are joined with the corpus counts and summed up by text. Null text
    is empty, its only token the end; rows alike in id and text share their sums and are
    returned as often; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key")).alias("row"), text.alias("text"))
    row_type = source.schema["row"].dataType.simpleString()
    partial = written(source.mapInArrow(lambda it: emptied(_score(it, model, vocabulary)), f"id {row_type}, n_tokens bigint, n_known bigint, base double, partial double, others array<struct<word:bigint,times:bigint>>"), "partial-scores")
    rare = (
        partial.select(F.col("id.key").alias("key"), "others").dropDuplicates(["key"]).select("key", F.explode("others").alias("o"))
        .select("key", "o.word", "o.times").join(words.select("word", "n"), "word")
        .groupBy("key").agg(F.sum("times").alias("rare_known"), F.sum(F.round(F.col("times") * F.log10(F.col("n") + 1.0), 12)).alias("rare"))
    )
    per_token = float(np.log10(vocabulary.train_tokens + vocabulary.train_types + 1.0))
    more = F.coalesce("rare", F.lit(0.0))
    return partial.withColumn("key", F.col("id.key")).join(rare, "key", "left").select(
        F.col("id.id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("partial") + more).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents by a model of those that are not held out (1 of 7)."""
    docs = table(spark, sf_dir, "documents")
    model, vocabulary, words = learn(docs.where(fold("doc_id", 7) != 2))
    found = score(docs, model, vocabulary, words)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
