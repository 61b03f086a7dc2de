import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("leftover", [False, True])
def test_the_rest_imports_without_the_training_data_folders(tmp_path, leftover):
    root = Path(e.__file__).parent
    (tmp_path / "__spark_entry__.py").write_bytes((root / "__spark_entry__.py").read_bytes())
    for f in (root / "ledgerlake").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(f.read_bytes())
    if leftover:  # what git leaves behind
        (tmp_path / "ledgerlake" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120).returncode == 0
