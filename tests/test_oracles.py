"""Queries next to their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import check
from rasterlake.plans import load_all

SF = "/root/testdata/sf0.001"
SLOW = ("r0", "r1", "r2", "p08", "p12", "a0", "a27", "p10", "j02")
QUICK = [n for n, q in load_all().items() if q.sql is not None and not n.startswith(SLOW)]
NAMES = QUICK if os.environ.get("ALL_QUERIES") else QUICK[:: max(1, len(QUICK) // 40)]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    q = load_all()[name]
    df = q(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(q.sql)
    assert check.compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry_module

    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
