"""The engine works where the corpus operators and their tests are not there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as entry
found, sql = entry.queries(), entry.oracle_sql()
assert "chunk_documents" in found and set(sql) <= set(found), sorted(found)
assert not [n for n in found if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in found
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "*.txt"))
    assert not list(copy.rglob("llm"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_nothing_else_imports_the_corpus_folder():
    for file in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "textloom").parts:
            lines = [x for x in file.read_text().splitlines() if x.lstrip().startswith(("import ", "from "))]
            assert not [x for x in lines if ".llm" in x], file
