"""The entry without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; from catalog import QUERIES; print(len(set(e.queries()) - set(QUERIES)), len(set(QUERIES) - set(e.queries())))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_table_queries_load_without_the_corpus_operators(tmp_path, also):
    """With the package gone, and with the pipeline gone as well."""
    left_out = {"llm", ".git", "tests", "__pycache__", *also}
    for path in [*REPO.rglob("*.py"), *REPO.rglob("*.yaml")]:
        inside = path.relative_to(REPO)
        if not left_out & set(inside.parts):
            (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inside).write_bytes(path.read_bytes())
    found = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.stdout.split() == ["0", "0"], found.stderr
