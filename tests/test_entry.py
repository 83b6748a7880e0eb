import importlib
import importlib.util
import sys

import pytest


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lexmill.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    names = set(e.queries())
    assert "process_pipeline" in names
    assert not [n for n in names if n == "pipeline" or n.startswith("op1")]
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_broken_training_data_operators_are_an_error(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lexmill.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexmill.llm.pii", None)
    if importlib.util.find_spec("lexmill.llm") is None:
        return
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_nothing_else_imports_them():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "lexmill"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lexmill.llm") for n in names), path
