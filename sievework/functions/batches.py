"""Descriptors of whole batches of sequences with numpy, all letters of a batch at once; ``sequences`` has them as Columns.

Null gives null, an empty sequence what the Columns give it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from . import scales


def code_points(sequences: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all strings in a row, their n + 1 offsets, which strings are there); null counts as empty."""
    there = sequences.notna().to_numpy()
    texts = sequences.fillna("").tolist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(s) for s in texts])]).astype(np.int64), there


class Batch:
    """A batch's letters, with the row and the place in it of each."""

    def __init__(self, sequences: pd.Series) -> None:
        self.points, ends, self.there = code_points(sequences)
        self.index, self.first, self.n = sequences.index, ends[:-1], np.diff(ends)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(self.points)) - self.first[self.row]
        self.low = np.minimum(self.points, 128).astype(np.int64)  # 128 stands for all letters that no scale has

    def of(self, table: dict[str, float]) -> np.ndarray:
        """Each letter's value, 0 for letters that ``table`` lacks."""
        values = np.zeros(129)
        values[[ord(a) for a in table]] = list(table.values())
        return values[self.low]

    def among(self, members: str) -> np.ndarray:
        """Which letters are among ``members``."""
        return self.of(dict.fromkeys(members, 1.0)) > 0

    def count(self, which: np.ndarray) -> np.ndarray:
        """Of each row how many letters are marked."""
        return np.bincount(self.row[which], minlength=len(self.n)).astype(float)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Each row's sum over its letters, in their order."""
        return np.bincount(self.row, weights=values, minlength=len(self.n))

    def most(self, values: np.ndarray) -> np.ndarray:
        """Each row's largest value; 0 for a row without letters."""
        out, some = np.zeros(len(self.n)), self.n > 0
        if some.any():
            out[some] = np.maximum.reduceat(values, self.first[some])
        return out

    def series(self, values: np.ndarray) -> pd.Series:
        """As doubles, null for null."""
        return pd.Series(np.where(self.there, values, np.nan), index=self.index)

    def windows(self, values: np.ndarray, window: int) -> np.ndarray:
        """The sum over each letter and those after it, ``window`` in all or fewer at a row's end."""
        out = values.astype(float)
        left = self.n[self.row] - self.at
        for j in range(1, min(window, int(self.n.max(initial=0)))):
            out[:-j] += np.where(left[:-j] > j, values[j:], 0.0)
        return out

    def share(self, part: np.ndarray) -> np.ndarray:
        """``part`` by the length; null without letters."""
        return np.divide(part, self.n, out=np.full(len(self.n), np.nan), where=self.n > 0)

    def run(self, which: np.ndarray) -> np.ndarray:
        """The longest stretch of marked letters."""
        place = np.arange(len(which))
        broken = np.maximum.accumulate(np.where(which, self.first[self.row] - 1, place)) if len(which) else place
        return self.most(place - broken)

    def repeat(self) -> np.ndarray:
        """The longest stretch of one letter; line ends count as none."""
        place, fresh = np.arange(len(self.points)), self.at == 0
        fresh[1:] |= self.points[1:] != self.points[:-1]
        begin = np.maximum.accumulate(np.where(fresh, place, 0)) if len(place) else place
        return self.most(np.where(np.isin(self.points, [10, 13, 0x85, 0x2028, 0x2029]), 0, place - begin + 1))

    def waves(self, angle: float) -> tuple[np.ndarray, np.ndarray]:
        """Each letter's cosine and sine."""
        turn = math.radians(angle) * np.arange(int(self.n.max(initial=0)))
        return np.cos(turn)[self.at], np.sin(turn)[self.at]

    def moment(self, window: int = 11, angle: float = 100.0, truncate_tail: bool = True) -> np.ndarray:
        """The largest hydrophobic moment over the windows."""
        size = self.of(scales.EISENBERG)
        x, y = (self.windows(size * wave, window) for wave in self.waves(angle))
        n = self.n[self.row]
        found = np.sqrt(x * x + y * y) / np.minimum(window, n - self.at)
        return self.most(found if truncate_tail else np.where(self.at <= np.maximum(n - window, 0), found, 0.0))

    def face(self, angle: float = 100.0) -> np.ndarray:
        """Of the letters within 90 degrees of the moment's direction the share that is hydrophobic; 0 without a direction."""
        size, (cos, sin) = self.of(scales.EISENBERG), self.waves(angle)
        x, y = self.total(size * cos), self.total(size * sin)
        facing = cos * x[self.row] + sin * y[self.row] >= -1e-12
        held, water_fearing = self.count(facing), self.count(facing & self.among(scales.HYDROPHOBIC))
        return np.divide(water_fearing, held, out=np.zeros(len(self.n)), where=(held > 0) & ((x != 0) | (y != 0)))

    def charged(self) -> tuple[list[tuple[np.ndarray, float]], list[tuple[np.ndarray, float]]]:
        """(number, pKa) of the letters that gain charge, and of those that lose it; both ends come first."""
        ends = np.ones(len(self.n))
        sides = (scales.PKA_FIRST, scales.PKA_POSITIVE), (scales.PKA_LAST, scales.PKA_NEGATIVE)
        return tuple([(ends, own), *[(self.count(self.among(a)), pka) for a, pka in table.items()]] for own, table in sides)

    def charge(self, ph: float = 7.4) -> np.ndarray:
        """Net charge, both ends free."""
        gain, lose = self.charged()
        return sum(k / (1 + 10.0 ** (ph - pka)) for k, pka in gain) - sum(k / (1 + 10.0 ** (pka - ph)) for k, pka in lose)

    def isoelectric(self, steps: int = 40) -> np.ndarray:
        """The pH at which the charge vanishes, by ``steps`` halvings of 0 to 14; letters are counted once."""
        gain, lose = self.charged()
        lo, hi = np.zeros(len(self.n)), np.full(len(self.n), 14.0)
        for _ in range(steps):
            mid = (lo + hi) / 2
            power = 10.0**mid
            up = sum(k / (1 + power * 10.0**-pka) for k, pka in gain) > sum(k / (1 + 10.0**pka / power) for k, pka in lose)
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        return (lo + hi) / 2

    def pair_index(self, weights: dict[str, float], default: float = 1.0) -> np.ndarray:
        """10 / length times the weights of neighbouring pairs; 0 for fewer than two letters."""
        known = {(ord(p[0]) << 32) | ord(p[1]): w for p, w in weights.items() if len(p) == 2}
        keys = np.array(sorted(known), np.uint64)
        pairs = (self.points[:-1].astype(np.uint64) << np.uint64(32)) | self.points[1:]
        values = np.full(len(self.points), default)
        if len(keys) and len(pairs):
            near = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            values[:-1] = np.where(keys[near] == pairs, np.array([known[int(k)] for k in keys])[near], default)
        total = self.total(np.where(self.at < self.n[self.row] - 1, values, 0.0))
        return np.divide(10.0, self.n, out=np.zeros(len(self.n)), where=self.n >= 2) * total


#: The descriptors that are whole numbers.
WHOLE = ("length", "run_hydrophobic", "run_identical", "run_positive", "count_c", "count_m", "count_p", "count_g", "positive_window")


def descriptors(sequences: pd.Series, pair_weights: dict[str, float] | None = None) -> pd.DataFrame:
    """All descriptors, a column of doubles for each."""
    b = Batch(sequences)
    own = {a: b.count(b.among(a)) for a in scales.ALPHABET}
    mean = lambda scale: b.share(sum((own[a] * v for a, v in scale.items()), 0.0))
    share = lambda members: b.share(sum(own[a] for a in members))
    charge, eis, mu, positive = b.charge(), mean(scales.EISENBERG), b.moment(), share(scales.POSITIVE)
    out = {f"frac_{a.lower()}": b.share(own[a]) for a in scales.ALPHABET}
    out |= {
        "length": b.n, "log_length": np.log(b.n, out=np.full(len(b.n), np.nan), where=b.n > 0), "charge": charge, "charge_density": b.share(charge),
        "gravy": mean(scales.HYDROPATHY), "eisenberg": eis, "octanol": mean(scales.OCTANOL), "boman": mean(scales.BOMAN), "helix": mean(scales.HELIX),
        "moment": mu, "moment_beta": b.moment(7, 180.0), "amphipathicity": mu * np.fmax(eis, 0.0),
        "frac_positive": positive, "frac_negative": share(scales.NEGATIVE), "frac_hydrophobic": share(scales.HYDROPHOBIC), "frac_aromatic": share(scales.AROMATIC), "frac_small": share(scales.SMALL),
        "run_hydrophobic": b.run(b.among(scales.HYDROPHOBIC)), "run_identical": b.repeat(), "run_positive": b.run(b.among(scales.POSITIVE)),
        "aliphatic": 100 * (share("A") + 2.9 * share("V") + 3.9 * share("IL")), "isoelectric": b.isoelectric(), "lys_share": share("K") / np.fmax(positive, 1e-9),
        **{f"count_{a.lower()}": own[a] for a in "CMPG"},
        "positive_window": b.most(b.windows(b.among(scales.POSITIVE), 5)), "face": b.face(),
    }
    if pair_weights is not None:
        out["instability"] = b.pair_index(pair_weights)
    return pd.DataFrame({name: b.series(values) for name, values in out.items()}, index=b.index)
