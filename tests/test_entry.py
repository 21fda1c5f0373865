"""The entry keeps the core queries where the corpus operators, or a package they need, are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", ["xxhash", "ragloom.llm", "corpus_pipeline"])
def test_entry_without(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(len(e.oracle_sql()))"
    names = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert "q_retrieve_sparse" in names and "pipeline" not in names and int(names[-1]) > 50
    assert any(n.startswith("op") for n in names) == (gone == "corpus_pipeline" and (ROOT / "ragloom" / "llm").exists())
