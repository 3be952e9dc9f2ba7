"""The entry module without the corpus subpackage, its tests or its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("podium/llm", "tests/llm"), ("podium/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without(gone, tmp_path):
    shutil.copytree(ROOT / "podium", tmp_path / "podium", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True) if "." not in name else (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, sum(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    # the copy alone counts: neither PYTHONPATH nor the user's site may lead to this repository
    path = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and not (Path(x) / "podium").exists()]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": os.pathsep.join(path)} if path else {})
    code = f"import os, sys; sys.path[:] = [p for p in sys.path if os.path.realpath(p or '.') != {str(ROOT)!r}]; import podium; assert podium.__path__[0].startswith(os.getcwd()); {code}"
    n, pipeline, ops, known = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) > 100 and pipeline == "False" and known == "True"
    assert (int(ops) > 0) == ("podium/llm" not in gone and (ROOT / "podium/llm").exists())
