from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, difference
from conftest import TESTDATA

import __spark_entry__ as contract
from stallwise.llm import registry

ROOT = Path(__file__).resolve().parents[2]
FOLDER = str(TESTDATA / "sf0.001")


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), registry.ORACLE_SQL[name]) is None


def test_all_are_registered():
    assert [name.split("_")[0] for name in registry.QUERIES] == [f"op{n}" for n in range(1, len(registry.QUERIES) + 1)]
    assert {*registry.QUERIES, "pipeline"} <= contract.queries().keys()


def test_the_rest_stands_without_them(tmp_path):
    for name in ("stallwise", "oracle", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys() and 'pipeline' not in e.queries(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 70, done.stderr
