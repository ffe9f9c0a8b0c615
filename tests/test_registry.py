"""The registry without libraries or folders that only the corpus operators need."""

import importlib
import sys

import pytest

from quarrykit.plans import catalog


@pytest.mark.parametrize("absent", ["xxhash", "quarrykit.llm"])
def test_without(monkeypatch, absent):
    for name in [n for n in sys.modules if n.startswith("quarrykit.llm") or n in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    if "quarrykit" in sys.modules:
        monkeypatch.delattr(sys.modules["quarrykit"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, absent, None)
    with pytest.warns(UserWarning, match="left out"):
        entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.QUERIES) and entry.oracle_sql() == catalog.ORACLE_SQL
    monkeypatch.delitem(sys.modules, "__spark_entry__")  # the next import is a whole one


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
