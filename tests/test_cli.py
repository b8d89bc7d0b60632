"""The command line, run in-process against the active test session."""

from __future__ import annotations

import pytest

from vitrine.__main__ import main
from vitrine.plans.readonly import ReadOnlyViolation

SF = "/root/testdata/sf0.001"


def test_sql_command(spark, capsys):
    assert main(["sql", "--testdata", SF,
                 "SELECT segmento_cliente, COUNT(*) AS n FROM clientes_segmentacao GROUP BY 1"]) == 0
    out = capsys.readouterr().out
    assert "VIP" in out and "REGULAR" in out


def test_sql_command_refuses_writes(spark):
    with pytest.raises(ReadOnlyViolation):
        main(["sql", "--testdata", SF, "DROP VIEW clientes_segmentacao"])


def test_report_command(spark, scratch, capsys):
    assert main(["report", "--testdata", SF, "--out", scratch, "--date", "2024-05-01"]) == 0
    assert "## criticos" in capsys.readouterr().out
    back = spark.read.parquet(f"{scratch}/criticos")
    assert back.count() == 10 and back.first().data_relatorio.isoformat() == "2024-05-01"


TABLES = ("public_gold_sales.vendas_temporais", "public_gold_cs.clientes_segmentacao",
          "public_gold_pricing.precos_competitividade")


@pytest.fixture
def loaded(spark, scratch):
    """Gold tables loaded through the command line from small raw files."""
    from tests.fixtures import customer, obs, product, raw, sale
    r = raw(spark, [sale(1, "2024-01-07 10:00:00", cliente="a"), sale(2, "2024-02-08 11:00:00", cliente="b")],
            [customer("a"), customer("b")], [product("p1", "10.00")],
            [obs("p1", "A", "9.00", "2024-01-01 00:00:00")])
    for name, df in r.as_dict().items():
        df.write.parquet(f"{scratch}/raw/{name}.parquet")
    assert main(["init", "--replace"]) == 0
    assert main(["load", "--raw", f"{scratch}/raw"]) == 0
    yield scratch
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_refused_load_keeps_the_old_rows(spark, loaded):
    from vitrine.sources.tables import ContractViolation

    before = {t: sorted(map(str, spark.table(t).collect())) for t in TABLES}
    assert len(before[TABLES[0]]) == 2
    # the mapped id_venda repeats in the driver tables, so the sales key contract fails
    with pytest.raises(ContractViolation, match="id_venda"):
        main(["load", "--testdata", SF])
    assert {t: sorted(map(str, spark.table(t).collect())) for t in TABLES} == before
    assert main(["init"]) == 0                                   # creates nothing, drops nothing
    assert {t: sorted(map(str, spark.table(t).collect())) for t in TABLES} == before


def test_report_and_sql_over_loaded_tables(spark, loaded, capsys):
    assert main(["report", "--catalog", "--out", f"{loaded}/report", "--date", "2024-05-01"]) == 0
    assert spark.read.parquet(f"{loaded}/report/vendas").count() == 2
    capsys.readouterr()
    assert main(["sql", "--catalog", f"SELECT COUNT(*) AS n FROM {TABLES[0]}"]) == 0
    assert "2" in capsys.readouterr().out
    with pytest.raises(ReadOnlyViolation):
        main(["sql", "--catalog", "SELECT * FROM parquet.`/tmp`"])


def test_whole_results_and_cut_display(spark, scratch, capsys):
    text = "SELECT id_cliente FROM public_gold_cs.clientes_segmentacao"
    assert main(["sql", "--testdata", SF, text, "--out", f"{scratch}/all"]) == 0
    assert spark.read.parquet(f"{scratch}/all").count() == 150
    capsys.readouterr()
    assert main(["sql", "--testdata", SF, text, "--limit", "3"]) == 0
    assert "there are more" in capsys.readouterr().out
    assert main(["sql", "--testdata", SF, text, "--limit", "150"]) == 0
    assert "there are more" not in capsys.readouterr().out


def test_commands_leave_no_intermediate_folder(spark, scratch):
    import os
    from urllib.parse import urlparse

    from vitrine.session import checkpoint_dir
    folder = urlparse(checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    assert main(["report", "--testdata", SF, "--out", f"{scratch}/r"]) == 0
    assert set(os.listdir(folder)) == before
