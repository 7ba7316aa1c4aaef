"""Every query against its SQL check, on the smallest tables (FLEETLENS_SF_DIR chooses others)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF_DIR = os.environ.get("FLEETLENS_SF_DIR", "/root/testdata/sf0.001")
LARGER_DIR = "/root/testdata/sf0.01"
CORPUS = set(entry.corpus_queries())
QUERIES, ORACLES = ({name: of[name] for name in of if name not in CORPUS} for of in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problem = difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    if problem == "no rows":
        # Too few rows in the smallest tables: an answer without rows says nothing, so larger ones decide.
        problem = difference(QUERIES[name](spark, LARGER_DIR), duck(LARGER_DIR), ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
