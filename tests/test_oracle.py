"""Every registered query against its DuckDB SQL on the smallest driver tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# the text operators and their pipeline are optional and tested with their subpackage
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_oracle_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert res["ok"], res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["nome_produto", "categoria", "nosso_preco", "preco_medio_concorrentes",
                          "diferenca_percentual_vs_media", "receita_total"]
