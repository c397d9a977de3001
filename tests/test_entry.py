"""The driver's entry points, with and without the training-data subpackage."""

import importlib
import sys

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_without_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tagmill.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tagmill.llm") or name == "corpus_pipeline":
                raise ImportError(name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    again = importlib.import_module("__spark_entry__")
    assert "j4_directional" in again.queries() and not any(q.startswith("op") for q in again.queries())
