"""A local session and the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievework.session import local_session

    session = local_session(4, 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    con.sql("set memory_limit='4GB'")
    for name in os.listdir(SMALL):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def same_rows(frame, con, sql: str) -> None:
    """The frame's rows are the SQL's, whatever their order."""
    names = sorted(frame.columns)
    tidy = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    mine = sorted(repr([tidy(r[n]) for n in names]) for r in frame.collect())
    found = con.sql(sql)
    at = [found.columns.index(n) for n in names]
    assert len(found.columns) == len(names)
    theirs = sorted(repr([tidy(r[i]) for i in at]) for r in found.fetchall())
    assert mine == theirs
