"""What the entry does without the subpackage of training-data operators, and with a broken one."""

import importlib
import importlib.util
import sys

import pytest


class Lacking:
    """Makes a module impossible to find."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.fixture
def lacking(monkeypatch):
    def without(name):
        for loaded in [m for m in sys.modules if m == "__spark_entry__" or m.startswith("tidemark.llm")]:
            monkeypatch.delitem(sys.modules, loaded)
        monkeypatch.delitem(sys.modules, name, raising=False)
        if "tidemark" in sys.modules:
            monkeypatch.delattr(sys.modules["tidemark"], "llm", raising=False)
        monkeypatch.setattr(sys, "meta_path", [Lacking(name), *sys.meta_path])
        return importlib.import_module("__spark_entry__")

    yield without
    sys.modules.pop("__spark_entry__", None)


def test_without_the_subpackage(lacking):
    entry = lacking("tidemark.llm")
    from tidemark.plans.queries import QUERIES

    assert set(entry.queries()) == set(QUERIES)


def test_a_broken_subpackage_raises(lacking):
    if importlib.util.find_spec("tidemark.llm") is None:
        pytest.skip("no subpackage")
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        lacking("xxhash")
