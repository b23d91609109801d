import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_without_llm():
    hits = [p for p in REPO.rglob("*.py") if "llm" not in p.relative_to(REPO).parts and "corvane.llm" in p.read_text() and p.name not in ("__spark_entry__.py", "test_entry.py")]
    assert hits == []
    for blocked in ("corvane.llm", "zstandard"):
        code = f"import sys; sys.modules['{blocked}'] = None\nimport __spark_entry__ as e; print(len(e.queries()) > 40 and 'p2_found' in e.queries() and 'p1_found' not in e.queries())"
        assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True).stdout.strip() == "True", blocked
