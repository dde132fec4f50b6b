"""The entry stays alive where a library of the text operators is missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def registered(before: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); {before}; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())


def test_a_missing_library_leaves_the_other_queries():
    every = registered("pass")
    for name in ("ahocorasick", "zstandard", "shelfcast.llm"):
        rest = registered(f"sys.modules[{name!r}] = None")
        assert "naive_metrics" in rest and "pipeline" not in rest
        assert rest == {q for q in every if not (q == "pipeline" or q.startswith("op") and q[2:3].isdigit())}
