"""The driver's entry without the folders that it may remove."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
_SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_queries_without_the_removed_folders(tmp_path, with_pipeline):
    gone = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "copy", ignore=gone)
    out = subprocess.run([sys.executable, "-c", _SAY], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles, pipeline, numbered = out.stdout.split()[-4:]
    assert int(queries) > 40 and int(oracles) > 30 and pipeline == numbered == "False"
