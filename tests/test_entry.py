"""The contract's functions, also where an optional library is missing."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names_without(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in done.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("library", ["ahocorasick", "sentencepiece", "recall_engine.llm", "corpus_pipeline"])
def test_a_missing_library_hides_its_own_queries_only(library):
    entry = importlib.import_module("__spark_entry__")
    every, others = entry.queries(), {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    left, oracles = names_without(library)
    assert others <= left <= set(every) and oracles <= left
    if library == "ahocorasick" and "op5_url_vocabulary" in every:
        assert set(every) - left == {"op5_url_vocabulary"}


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
