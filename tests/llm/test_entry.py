"""The entry works without what the text operators need."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry_point


def test_text_operators_are_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(any(q.startswith(n) for q in entry_point.queries()) for n in names)
    assert "pipeline" in entry_point.queries()


@pytest.mark.parametrize("missing", ["public_tokenizers", "eraframe.llm", "numpy"])
def test_entry_without_a_package(monkeypatch, missing):
    every = set(entry_point.queries())
    own = [m for m in sys.modules if m.startswith("eraframe.llm") or m == "corpus_pipeline"]
    for module in own:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        bare = importlib.reload(entry_point)
        without = {q for q in every if not q.startswith("op") and q != "pipeline"}
        assert bare.text_queries is None and set(bare.queries()) == without
        assert set(bare.oracle_sql()) == without
    finally:
        monkeypatch.undo()
        importlib.reload(entry_point)
    assert set(entry_point.queries()) == every
