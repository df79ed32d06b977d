"""The driver contract, with and without the document operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql())); " \
         "print([n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"


def listed(folder):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=environment,
                          capture_output=True, text=True, timeout=120)


def copied(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__")
        or str(Path(folder, n).relative_to(ROOT)) in without])
    return tmp_path / "copy"


def test_imports_without_the_document_operators(tmp_path):
    for i, without in enumerate([("touchflow/llm", "tests/llm"),
                                 ("touchflow/llm", "tests/llm", "corpus_pipeline.py")]):
        found = listed(copied(tmp_path / str(i), *without))
        assert found.returncode == 0, found.stderr
        assert found.stdout.splitlines()[1] == "[]"


def test_an_emptied_folder_is_no_module(tmp_path):
    folder = copied(tmp_path, "touchflow/llm")
    (folder / "touchflow/llm/__pycache__").mkdir(parents=True)
    found = listed(folder)
    assert found.returncode == 0, found.stderr
