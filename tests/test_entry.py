"""The driver's entry points, with and without the separable parts."""

import subprocess
import sys
from pathlib import Path
from shutil import copy, copytree

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    out = entry.entry(spark)
    assert out.columns == ["record_id", "burst", "new_country", "off_hours", "risk", "anomaly"] and not out.isEmpty()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_separable_parts(tmp_path):
    copytree(REPO / "authspan", tmp_path / "authspan", ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__")])
    copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
