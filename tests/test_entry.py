"""The entry module without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_folder(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = (
        "import __spark_entry__ as e; from riskloom.plans.catalog import QUERIES; "
        "assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES), e.queries().keys(); print(len(QUERIES))"
    )
    found = subprocess.run([sys.executable, "-c", code], cwd=tree, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) >= 74
