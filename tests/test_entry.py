from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*warehouse*"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "False"


def test_other_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*warehouse*"))
    (copy / "riskloom/llm").mkdir()
    (copy / "riskloom/llm/__init__.py").write_text("")
    (copy / "riskloom/llm/registry.py").write_text("import not_there\n")
    with pytest.raises(subprocess.CalledProcessError):
        subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, check=True)
