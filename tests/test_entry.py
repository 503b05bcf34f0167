"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 80
    assert e.entry(spark).columns == ["target", "peak_year", "peak_rate_per_million", "total_hits"]


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    """A copy of the repository without the subpackage, its tests and the pipeline."""
    top = tmp_path_factory.mktemp("without") / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    return top


def test_imports_without_the_subpackage(without):
    code = "import re, __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if re.match(r'op\\d+_|pipeline$', q)])"
    out = subprocess.run([sys.executable, "-c", code], cwd=without, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]") and int(out.split()[0]) >= 80


def test_tests_run_without_the_subpackage(without):
    base = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    found = subprocess.run([*base, "tests", "--collect-only"], cwd=without, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
    ran = subprocess.run([*base, "tests/test_kwic.py", "-k", "dumps or targets"], cwd=without, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_a_fault_inside_the_subpackage_is_raised(without, tmp_path):
    top = tmp_path / "broken"
    shutil.copytree(without, top)
    (top / "driftlex/llm").mkdir()
    (top / "driftlex/llm/__init__.py").write_text("import no_such_module_anywhere\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=top, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr
