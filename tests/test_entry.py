"""The entry point without the training-data package."""

import importlib
import sys

import __spark_entry__ as entry


class Hidden:
    """Finds no module of the package, as if its folder were deleted."""

    def find_spec(self, name, path=None, target=None):
        if name == "laborlens.llm" or name.startswith("laborlens.llm."):
            raise ModuleNotFoundError(name)
        return None


def test_other_queries_stay_without_the_package(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("laborlens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    importlib.invalidate_caches()
    names = set(entry.queries())
    assert "win_rank_matches" in names and "pipeline" not in names
    assert not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
