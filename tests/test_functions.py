"""Descriptors against golden values, parsing against hand-derived ones."""

from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import parsing, scales
from sievework.functions import sequences as seq
from sievework.operators import similarity

GOLDEN = [
    ("GIGKFLHSAKKFGKAFVGEIMNS", 23, 2.835449, 0.082609, 0.686239, 0.686239, 10.531287),
    ("KWKLFKKIGAVLKVL", 15, 4.795714, 0.540000, 1.060000, 0.687035, 11.132460),
    ("RRWQWR", 6, 2.799393, -3.133333, 2.530000, 0.536536, 12.781041),
    ("LLLFLLKKRKKRKY", 14, 6.793564, -0.571429, 0.987264, 0.270565, 11.742817),
]


def test_golden_descriptors(spark):
    s = F.col("s")
    rows = spark.createDataFrame([(g[0],) for g in GOLDEN], "s string").select(
        "s", F.length(s), seq.charge(s), seq.scale_mean(s, scales.HYDROPATHY), seq.moment(s), seq.moment(s, truncate_tail=False), seq.isoelectric_point(s)
    )
    for row, golden in zip(sorted(rows.collect()), sorted(GOLDEN), strict=True):
        assert list(row)[1:] == pytest.approx(list(golden)[1:], abs=2e-6)


def test_empty_and_null_sequences(spark):
    rows = spark.createDataFrame([("",), (None,), ("A",)], "s string")
    out = {r[0]: r.asDict() for r in rows.select("s", *[c.alias(n) for n, c in seq.descriptors(F.col("s")).items()]).collect()}
    assert out[""]["charge"] is not None and out[""]["gravy"] is None and out[""]["moment"] == 0 and out[""]["run_identical"] == 0
    assert out[None]["charge"] is None and out["A"]["run_identical"] == 1


def test_concentrations(spark):
    cases = [(">256", 256.0, True), ("≥32", 32.0, True), ("12,5", 12.5, False), ("2.1-4.2", 2.1, False), ("<4", 4.0, False), ("abc", None, False), (None, None, False), ("1,000", 1.0, False)]
    rows = spark.createDataFrame([c[:1] for c in cases], "raw string").select("raw", parsing.concentration(F.col("raw")), parsing.is_censored(F.col("raw"))).collect()
    assert [tuple(r) for r in rows] == cases


def test_bins(spark):
    rows = spark.createDataFrame([(12,), (13,), (41,), (None,)], "v int").select(seq.bin_of(F.col("v"), scales.LENGTH_EDGES)).collect()
    assert [r[0] for r in rows] == [0, 1, 6, None]


def test_sketch_keys():
    keys = similarity.sketch_keys(pd.Series(["KWKLFKKIGAVLKVL", "KW", "small ring", None]))
    assert list(keys[:3]) == [3142140, 3122379, 2489393] and keys.isna()[3]


def lcs(a: str, b: str) -> int:
    line = [0] * (len(b) + 1)
    for x in a:
        before = line[:]
        for j, y in enumerate(b):
            line[j + 1] = before[j] + 1 if x == y else max(line[j], before[j + 1])
    return line[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=70))
def test_indel_ratio_is_symmetric_and_gated(a, b):
    one, other = similarity.indel_ratios(pd.Series([a]), pd.Series([b]))[0], similarity.indel_ratios(pd.Series([b]), pd.Series([a]))[0]
    assert one == other == (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
    for t in (0.6, 0.75, 0.8):
        if one > t:
            assert min(len(a), len(b)) >= similarity.length_gate(t) * max(len(a), len(b)) - 1e-9


def test_indel_examples():
    found = similarity.indel_ratios(pd.Series(["KWKLFKKIGAVLKVL", "GIGKFLHSAK", "abc"]), pd.Series(["KWKLFKKI", "GIGKWLHSAK", "axc"]))
    assert list(found.round(6)) == [0.695652, 0.9, 0.666667]


def test_grams_beyond_the_first_plane(spark):
    row = spark.createDataFrame([("a😀bc",), ("abcd",), ("a",)], "s string").select(seq.grams(F.col("s"), 2)).collect()
    assert [r[0] for r in row] == [["a😀", "😀b", "bc"], ["ab", "bc", "cd"], []]
