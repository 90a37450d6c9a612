"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.verify import compare, connect

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "doc_id", "score", "dense_rank", "lexical_rank", "place"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    n, ok, why = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SMALL)
    assert ok is not False, why
    assert n >= 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(monkeypatch):
    """Queries of the training-data subpackage vanish with it, the others stay."""
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tallyloom.llm") else real(name, *a))
    names = set(entry.queries())
    assert "a20_rrf" in names and not any(n.startswith(("p1_", "p4_", "p5_")) for n in names)
