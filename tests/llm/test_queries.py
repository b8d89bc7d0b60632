"""Registered text queries against their SQL; native plans; the guard of the entry module."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck
from vitrine.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
PYTHON_NODES = re.compile(r"Python|Pandas|Arrow")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    res = compare(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert res["ok"], res


@pytest.mark.parametrize("name", ["op2_secret_scan", "op3_quality_rules", "op4_benchmark_decontamination"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON_NODES.search(plan)


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_entry_works_without_the_subpackage():
    """The entry module imports and lists the other queries when the text folders are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('vitrine.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 30 and not any(n.startswith('op') for n in e.queries())\n"
        "assert set(e.queries()) == set(e.oracle_sql())\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
