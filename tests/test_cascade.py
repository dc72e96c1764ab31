"""The whole selection, over more candidates than the shortlist holds."""

from __future__ import annotations

import numpy as np

from sievework.functions import scales
from sievework.plans import cascade, selection_queries


def test_candidates_outside_the_shortlist_fill_quotas(spark):
    rng = np.random.default_rng(5)
    make = lambda n: ["".join(rng.choice(list(scales.ALPHABET), rng.integers(10, 24))) for _ in range(n)]
    pool = spark.createDataFrame(list(enumerate(dict.fromkeys(make(600)))), "row_id long, sequence string").cache()
    reference = spark.createDataFrame([(s,) for s in make(60)], "sequence string").cache()
    # at most 40 of each cell are shortlisted: all candidates can be chosen only from the whole pool
    settings = cascade.Settings(total=600, top_k=4, shortlist=50, walk=20)
    library, tops = cascade.build_library(pool, reference, selection_queries.stub_scorers(), selection_queries.stub_strains(), settings)
    rows = library.collect()
    assert sorted(r.pos for r in rows) == list(range(1, 601)) and len({r.sequence for r in rows}) == 600
    assert set(tops) == set(settings.objectives) and len(tops) == 5
    listed = {r.row_id for top in tops.values() for r in top.collect()}
    assert listed and {r.row_id for r in rows if r.pos <= len(listed)} == listed
    assert any("composition gap" in line for line in settings.log)
