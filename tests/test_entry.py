"""The entry where training-data operators, or what they need, are missing."""

import importlib
import sys
import warnings

import pytest

import __spark_entry__ as entry
from tagloom.plans.queries import QUERIES


@pytest.fixture
def fresh(monkeypatch):
    """Import the entry anew, with some modules hidden."""

    def load(*hidden):
        for name in [m for m in sys.modules if m.startswith("tagloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
            monkeypatch.delitem(sys.modules, name)
        for name in hidden:
            monkeypatch.setitem(sys.modules, name, None)
        return importlib.import_module("__spark_entry__")

    yield load


def test_without_the_training_data_operators(fresh):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = fresh("tagloom.llm", "corpus_pipeline")
    assert found.queries().keys() == QUERIES.keys() == found.oracle_sql().keys()


def test_without_a_library_that_they_need(fresh):
    pytest.importorskip("tagloom.llm")
    with pytest.warns(UserWarning, match="ahocorasick"):
        found = fresh("ahocorasick")
    assert found.queries().keys() == QUERIES.keys()


def test_every_counterpart_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
