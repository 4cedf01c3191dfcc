from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from verification.catalog import QUERIES
from verification.oracle import statements

ROOT = Path(__file__).resolve().parent.parent
LISTED = """
import json, __spark_entry__ as entry
print(json.dumps([sorted(entry.queries()), sorted(entry.oracle_sql())]))
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_the_core_is_listed_without_the_training_text_operators(tmp_path, pipeline_stays):
    shutil.copytree(ROOT / "verification", tmp_path / "verification")
    shutil.copytree(ROOT / "creditloom", tmp_path / "creditloom", ignore=shutil.ignore_patterns("llm"))
    names = ["__spark_entry__.py"] + (["corpus_pipeline.py"] if pipeline_stays else [])
    for name in names:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    run = subprocess.run(
        [sys.executable, "-c", LISTED], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)},
        capture_output=True, text=True, check=True,
    )
    assert json.loads(run.stdout) == [sorted(QUERIES), sorted(statements())]
