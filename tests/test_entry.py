"""The entry points with and without the optional training-data package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"


def test_entry_stands_without_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "tarnfold"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, optional, covered = said.stdout.split()
    assert int(count) > 100 and optional == "0" and covered == "True", said.stderr
