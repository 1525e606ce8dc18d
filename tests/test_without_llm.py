"""The entry module in copies of the library from which the corpus operators were taken out."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_imports_without_the_corpus_operators(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(f"{ROOT}/marginalia", copy / "marginalia", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}") and not (pipeline_too and name == "corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/{name}", copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'), 'resolved_annotations' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120, check=False)
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip() == "[] True"
