"""Token ids of whole texts, with each distinct piece of a word encoded once a task."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The contents of an installed public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


#: What the bytes of a word are to ``split_pieces``: letters, marks, anything else.
LETTER, MARK, OTHER = 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[ord(c) for c in "-.,!?;:%*#$&|()"]] = MARK
KIND[SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of all words between ASCII white space in order; whether each is plain; the number of them before each text's end, n + 1 values).

    A plain word is letters up to U+00FF and then marks: these two are its pieces, lower-cased,
    as ``word_bpe_49k`` splits it. Any other word is one piece as it stands.
    """
    kind, low = KIND[data], LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
    kind[wide] = kind[wide + 1] = LETTER
    low[wide + 1] += ((data[wide + 1] < 0x9F) * 0x20).astype(np.uint8)
    begins = kind > 0
    begins[1:] &= kind[:-1] == 0
    cuts = ends[1:-1][ends[1:-1] < len(data)]
    begins[cuts] = kind[cuts] > 0
    inner = ~begins
    odd = kind == OTHER
    odd[1:] |= inner[1:] & (kind[1:] == LETTER) & (kind[:-1] == MARK)
    first = np.flatnonzero(begins)
    word = np.cumsum(begins, dtype=np.int32) - 1
    whole = np.zeros(len(first) + 1, bool)
    whole[word[np.flatnonzero(odd)]] = True
    turn = np.flatnonzero(inner[1:] & (kind[1:] == MARK) & (kind[:-1] == LETTER)) + 1
    begins[turn[~whole[word[turn]]]] = True
    solid = kind > 0
    at = np.flatnonzero(begins)
    if whole.any():
        as_is = np.flatnonzero(whole[word] & solid) if len(data) else np.zeros(0, np.int64)
        low[as_is] = data[as_is]
    before = np.cumsum(solid)
    offsets = np.append(before[at] - 1, before[-1] if len(before) else 0)
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[solid]))
    return pieces, ~whole[word[at]], np.searchsorted(at, ends)


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next code point from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b if b in own else 256 + sum(x not in own for x in range(b)) for b in range(256)}


class WordEncoder:
    """Encodes texts piece by piece, which a tokenizer that drops white space and splits at it allows.

    Plain pieces go to the merges directly; any other word goes through the whole tokenizer.

    ``vocabulary`` is a tokenizers JSON. At most ``limit`` pieces are remembered, and those of
    one call; beyond that the memory starts anew, which changes the speed only.
    """

    def __init__(self, vocabulary: str, end: int, limit: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.limit = Tokenizer.from_str(vocabulary), end, limit
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        """Only the end token stays, as piece 0."""
        self.known: dict[str, int] = {}
        self.ids = np.array([self.end], np.uint32)
        self.starts = np.array([0, 1], np.int64)

    def _places(self, distinct: list[str], plain: np.ndarray) -> np.ndarray:
        """The number of each piece; those not known are learnt."""
        found = list(map(self.known.get, distinct))
        new = [i for i, k in enumerate(found) if k is None]
        if new and len(self.known) + len(new) > self.limit and self.known:
            self.forget()
            found, new = [None] * len(distinct), list(range(len(distinct)))
        if new:
            own = plain[new].tolist()

            def tokenize(piece: str) -> list:
                return self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))

            other = iter(self.tokenizer.encode_batch_fast([distinct[i] for i, p in zip(new, own, strict=True) if not p], add_special_tokens=False))
            pieces = [[x.id for x in tokenize(distinct[i])] if p else next(other).ids for i, p in zip(new, own, strict=True)]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            base = len(self.starts) - 1
            for k, i in enumerate(new, base):
                found[i] = k
            self.known.update(zip([distinct[i] for i in new], range(base, base + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(pieces), np.uint32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.array(found, np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end token behind it, and n + 1 offsets into them."""
        pieces, plain, piece_ends = split_pieces(data, ends)
        coded = pieces.dictionary_encode()
        of = coded.indices.to_numpy()
        by_piece = np.zeros(len(coded.dictionary), bool)
        by_piece[of] = plain
        place = self._places(coded.dictionary.to_pylist(), by_piece)
        sequence = np.insert(place[of], piece_ends[1:], 0)
        first, sizes = self.starts[sequence], np.diff(self.starts)[sequence]
        reach = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - reach + sizes, sizes) + np.arange(int(reach[-1]) if len(reach) else 0)]
        text_ends = np.concatenate([[0], reach[piece_ends[1:] + np.arange(len(piece_ends) - 1)]])
        return ids, text_ends
