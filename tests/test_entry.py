"""The entry point stands without the llm subpackage, the pipeline or their libraries."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from leaselake.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "leaselake.llm", "zstandard"])
def test_what_cannot_be_imported_is_left_out(monkeypatch, hidden):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("leaselake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == SQL.keys()


def test_all_warehouse_queries_are_registered():
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= SQL.keys()
