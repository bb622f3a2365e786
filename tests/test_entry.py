"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
TELL = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_imports_without_the_training_data_operators(tmp_path, pipeline_stays):
    for part in ("__spark_entry__.py", "corpus_pipeline.py", "ledgerloom"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists() and (pipeline_stays or part != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / part)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", TELL], cwd=tmp_path, env=env, check=True, timeout=120)
