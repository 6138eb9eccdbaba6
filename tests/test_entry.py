"""The driver's entry works with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(before: str) -> set[str]:
    code = f"import sys; {before}; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    return set(out.stdout.split())


def test_other_queries_stand_without_the_operators():
    without = names("sys.modules['sievewell.llm'] = None")
    assert "bm25_search" in without and not any(n.startswith("op") or n == "pipeline" for n in without)
    assert without <= names("pass")
