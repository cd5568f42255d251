"""The entry file stands on its own: with the llm subpackage, without it, and without the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), 'pipeline' in q)"


def _names(folder: Path) -> list[str]:
    said = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    return said.stdout.strip().split(" ", 1)


@pytest.mark.parametrize("gone", [["tiepoints/llm"], ["tiepoints/llm", "corpus_pipeline.py"]])
def test_entry_without_the_llm_folders(tmp_path, gone):
    left_out = {str(ROOT / name) for name in [*gone, "tests/llm", ".git"]}
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda at, names: {n for n in names if f"{at}/{n}" in left_out or n == "__pycache__"})
    from tiepoints.plans.queries import QUERIES

    number, rest = _names(tree)
    assert int(number) == len(QUERIES)
    assert rest == "[] False"
