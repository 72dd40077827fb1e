"""The entry point with and without what is optional."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [(), ("chronolith/llm",), ("chronolith/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    for name in ("chronolith", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, bench; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    there = (tmp_path / "chronolith/llm").exists()
    assert "all_recency" in names and ("op1_license_scan" in names) == there
    assert ("pipeline" in names) == (there and (tmp_path / "corpus_pipeline.py").exists())


def test_pipeline_of_another_checkout_is_not_offered(tmp_path):
    shutil.copytree(ROOT / "chronolith", tmp_path / "chronolith", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    other = tmp_path / "other"
    other.mkdir()
    (other / "corpus_pipeline.py").write_text("ORACLE_SQL = 'SELECT 1'\nrun = None\n")
    path = os.pathsep.join(filter(None, [str(other), os.environ.get("PYTHONPATH")]))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True)
    assert "op1_license_scan" in said.stdout.split() and "pipeline" not in said.stdout.split()


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "chronolith").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text(encoding="utf-8")), path
