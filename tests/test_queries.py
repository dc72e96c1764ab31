"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL, same_rows

from sievework.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SMALL), duck, SQL[name])


SLOW = {"select_match_composition"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL) - {"cascade_library"}))
def test_without_sql_reruns_agree(spark, name):
    make = catalogue.queries()[name]
    first = make(spark, SMALL).collect()
    assert first and (name in SLOW or sorted(map(repr, first)) == sorted(map(repr, make(spark, SMALL).collect())))


def test_cascade_library_has_the_asked_size(spark):
    rows = catalogue.queries()["cascade_library"](spark, SMALL).select("sequence").collect()
    assert len(rows) == len(set(rows)) == 60


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
