"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "ballot_state" in e.queries()


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "psephos", tmp_path / "psephos", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ballot_state' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["ballot", "label", "numbers_found", "sequence_ok", "state"] and rows.count() > 0
