"""The driver's contract, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_optional_operators(tmp_path):
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] in ("lumbra", "__spark_entry__.py"):
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'op1_license_scan' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    count, has = said.stdout.split()
    assert int(count) >= 50 and has == "False"
