"""The driver's contract: names, columns, and a library that does not need the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    code = f"""
import sys, shutil
shutil.copytree({str(ROOT / 'brindle')!r}, {str(tmp_path / 'brindle')!r}, ignore=shutil.ignore_patterns('llm'))
shutil.copy({str(ROOT / '__spark_entry__.py')!r}, {str(tmp_path)!r})
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
assert 'hybrid_search' in e.queries() and 'pipeline' not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
