"""Dashboard datasets and report sections on hand fixtures."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.fixtures import customer, obs, product, raw, sale
from vitrine.plans import dashboard as dash
from vitrine.plans import reports as rep
from vitrine.plans.marts import build_marts


@pytest.fixture
def marts(spark):
    vendas = [
        sale(1, "2024-01-07 10:00:00", cliente="a", produto="p1", qty=2, price="10.00", canal="site"),
        sale(2, "2024-01-08 11:00:00", cliente="b", produto="p2", qty=1, price="30.00", canal="app"),
        sale(3, "2024-02-08 11:30:00", cliente="a", produto="p3", qty=1, price="5.00", canal=None),
        sale(4, "2024-02-09 23:00:00", cliente="ghost", produto="p1", qty=1, price="7.00",
             canal="site"),
    ]
    clientes = [customer("a", estado="SP"), customer("b", estado="RJ"),
                customer("c", estado="SP"), customer("d", estado=None)]
    produtos = [product("p1", "10.00", categoria="casa"), product("p2", "40.00", categoria="moda"),
                product("p3", "4.00", categoria=None)]
    precos = [obs("p1", "A", "12.00", "2024-01-01 00:00:00"),
              obs("p2", "A", "20.00", "2024-01-01 00:00:00"),
              obs("p3", "A", "5.00", "2024-01-01 00:00:00")]
    return build_marts(raw(spark, vendas, clientes, produtos, precos))


def test_sales_kpis_and_month_filter(marts):
    k = dash.sales_kpis(dash.sales_page(marts.sales)).first()
    assert (k.receita_total, k.total_vendas, k.clientes_unicos) == (D("62.00"), 4, 3)
    assert k.ticket_medio == 15.5 and k.receita_total_fmt == "R$ 62,00"
    jan = dash.sales_kpis(dash.sales_page(marts.sales, 1)).first()
    assert (jan.receita_total, jan.total_vendas) == (D("50.00"), 2)


def test_empty_page_gives_zero_revenue_and_mean(marts):
    k = dash.sales_kpis(dash.sales_page(marts.sales, 7)).first()
    assert (k.receita_total, k.total_vendas, k.ticket_medio, k.clientes_unicos) == (D("0.00"), 0, 0.0, 0)


def test_null_keys_are_absent_from_dashboard_groups(marts):
    assert {r.canal_venda for r in dash.revenue_by_channel(marts.sales).collect()} == {"site", "app"}
    assert {r.categoria for r in dash.top_categories(marts.sales).collect()} == {"casa", "moda"}
    assert {r.estado for r in dash.customers_by_state(marts.customers).collect()} == {"SP", "RJ"}


def test_weekday_order_and_days(marts):
    assert [r.dia_semana_nome for r in dash.revenue_by_weekday(marts.sales).collect()] == \
        ["Segunda", "Quinta", "Sexta", "Domingo"]
    assert [r.data_venda for r in dash.revenue_by_day(marts.sales).collect()] == [
        dt.date(2024, 1, 7), dt.date(2024, 1, 8), dt.date(2024, 2, 8), dt.date(2024, 2, 9)]
    assert [(r.mes_venda, r.mes_label) for r in dash.sales_months(marts.sales).collect()] == \
        [(1, "Jan"), (2, "Fev")]
    assert [(r.hora_venda, r.vendas) for r in dash.sales_by_hour(marts.sales).collect()] == \
        [(10, 1), (11, 2), (23, 1)]


def test_top_categories_shown_ascending(marts):
    rows = dash.top_categories(marts.sales, n=1).collect()
    assert [(r.categoria, r.receita_total) for r in rows] == [("moda", D("30.00"))]


def test_customer_page(marts):
    k = dash.customer_kpis(marts.customers).first()
    assert (k.total_clientes, k.clientes_vip, k.receita_vip) == (4, 2, D("55.00"))
    assert k.ticket_medio_geral == round((12.5 + 30.0) / 2, 6)
    top = dash.top_customers(marts.customers).collect()
    assert [r.id_cliente for r in top] == ["a", "b"]          # ghost (rank 3) is not a customer
    seg = {r.segmento_cliente: r.clientes for r in dash.customers_by_segment(marts.customers).collect()}
    assert seg == {"VIP": 2, "REGULAR": 2}
    rev = {r.segmento_cliente: r.receita_total
           for r in dash.revenue_by_segment(marts.customers).collect()}
    assert rev == {"VIP": D("55.00"), "REGULAR": D("0.00")}


def test_customer_table_filter_and_format(marts):
    rows = dash.customer_table(marts.customers).collect()
    assert [r.Rank for r in rows] == [1, 2, None, None]
    assert rows[0].Receita == "R$ 30,00" and rows[-1].Receita == "—"
    assert rows[1]["Ticket Médio"] == "R$ 12,50"
    vip = dash.customer_table(marts.customers, "VIP").collect()
    assert {r.Cliente for r in vip} == {"Cliente a", "Cliente b"}


def test_pricing_page(marts):
    p = marts.pricing
    assert [r.categoria for r in dash.price_categories(p).collect()] == ["casa", "moda"]
    k = dash.pricing_kpis(dash.pricing_page(p)).first()
    assert (k.total_produtos, k.mais_caros, k.mais_baratos) == (3, 1, 2)
    assert k.dif_media == pytest.approx((-16.67 + 100.0 - 20.0) / 3)
    assert k.dif_media_fmt == f"{(-16.67 + 100.0 - 20.0) / 3:+.1f}%"
    only_casa = dash.pricing_kpis(dash.pricing_page(p, ["casa"])).first()
    assert only_casa.total_produtos == 1
    full_list = dash.pricing_page(p, ["casa", "moda"]).count()
    assert full_list == 2                                     # NULL category dropped
    assert dash.pricing_page(p, []).count() == 3              # empty choice: no filter
    gaps = dash.price_gap_by_category(p).collect()
    assert [(r.categoria, r.sinal) for r in gaps] == [("casa", "mais_barato"), ("moda", "mais_caro")]
    alerts = dash.price_alerts(p).collect()
    assert [(a.Produto, a["Dif. %"], a["Nosso Preço"]) for a in alerts] == \
        [("Produto p2", "+100.0%", "R$ 40,00")]
    classes = {r.classificacao_preco: r.produtos for r in dash.products_by_price_class(p).collect()}
    assert classes == {"MAIS_CARO_QUE_TODOS": 1, "MAIS_BARATO_QUE_TODOS": 2}
    assert dash.price_vs_volume(p).count() == 3


def test_daily_grain_hourly_equals_sales_by_hour(marts):
    assert _rows(dash.daily_grain_sales_by_hour(marts.sales)) == _rows(dash.sales_by_hour(marts.sales))


def test_daily_grain_kpis(marts):
    k = dash.daily_grain_kpis(marts.sales).first()
    assert (k.receita_total, k.total_vendas, k.dias) == (D("62.00"), 4, 4)
    assert k.ticket_medio == 15.5 and k.clientes_max_dia == 1 and k.clientes_soma_dias == 4


def test_report_sections(spark, marts):
    days = rep.sales_last_days(marts.sales, days=3).collect()
    assert [r.data_venda for r in days] == [dt.date(2024, 2, 9), dt.date(2024, 2, 8),
                                            dt.date(2024, 1, 8)]
    seg = rep.segments_summary(marts.customers).collect()
    assert [r.segmento_cliente for r in seg] == ["VIP", "REGULAR"]
    assert seg[1].receita_total is None and seg[1].total_clientes == 2
    classes = rep.price_classes_summary(marts.pricing).collect()
    assert [(r.classificacao_preco, r.total_produtos) for r in classes] == \
        [("MAIS_BARATO_QUE_TODOS", 2), ("MAIS_CARO_QUE_TODOS", 1)]
    crit = rep.critical_products(marts.pricing).collect()
    assert [r.nome_produto for r in crit] == ["Produto p2"]


def test_failing_section_is_isolated(spark, marts):
    sections = dict(rep.SECTIONS)
    sections["quebrada"] = lambda m: m.sales.select(F.col("coluna_que_nao_existe"))
    sections["divisao"] = lambda m: m.sales.select((F.lit(1) / F.lit(0)).alias("x"))
    out = rep.run_report(spark, marts, sections)
    assert out["quebrada"].columns == ["erro"] and out["divisao"].columns == ["erro"]
    assert out["vendas"].count() == 4 and out["criticos"].count() == 1


def test_dated_report_output(spark, marts, scratch):
    sections = rep.run_report(spark, marts)
    day = dt.date(2024, 3, 1)
    rep.write_report(sections, scratch, day)
    rep.write_report(sections, scratch, day)                  # rerun: same partition replaced
    rep.write_report(sections, scratch, dt.date(2024, 3, 2))
    back = spark.read.parquet(f"{scratch}/vendas")
    counts = {r.data_relatorio: r["count"] for r in back.groupBy("data_relatorio").count().collect()}
    assert {str(k): v for k, v in counts.items()} == {"2024-03-01": 4, "2024-03-02": 4}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("month", [None, 2])
def test_sales_page_bundle_equals_single_datasets(marts, month):
    page = dash.sales_page(marts.sales, month)
    got = dash.sales_page_datasets(marts.sales, month)
    assert _rows(got["revenue_by_day"]) == _rows(dash.revenue_by_day(page))
    assert [tuple(r) for r in got["revenue_by_weekday"].collect()] == \
        [tuple(r) for r in dash.revenue_by_weekday(page).collect()]
    assert _rows(got["sales_by_hour"]) == _rows(dash.sales_by_hour(page))
    assert _rows(got["revenue_by_channel"]) == _rows(dash.revenue_by_channel(page))
    assert [tuple(r) for r in got["top_categories"].collect()] == \
        [tuple(r) for r in dash.top_categories(page).collect()]
    assert _rows(got["kpis"]) == _rows(dash.sales_kpis(page))
    assert got["months"].collect() == dash.sales_months(marts.sales).collect()
    pruned = dash.sales_page_datasets(marts.sales, month, prune=True)
    for name, df in got.items():
        assert [tuple(r) for r in pruned[name].collect()] == [tuple(r) for r in df.collect()], name
        assert dict(df.dtypes) == dict(pruned[name].dtypes)


def _counting(df):
    """The frame, and the number of its rows that tasks have read so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


@pytest.mark.parametrize("month", [None, 2])
def test_sales_page_reads_the_sales_once(marts, month):
    sales, seen = _counting(marts.sales)
    got = dash.sales_page_datasets(sales, month)
    assert len(got) == 7
    for df in got.values():
        df.collect()
    assert seen.value == marts.sales.count()


def test_sales_page_of_a_month_without_sales(marts):
    empty = dash.sales_page_datasets(marts.sales, 7)
    assert _rows(empty["kpis"]) == _rows(dash.sales_kpis(dash.sales_page(marts.sales, 7)))
    assert [r.mes_venda for r in empty["months"].collect()] == [1, 2]
    assert all(df.count() == 0 for name, df in empty.items() if name not in ("kpis", "months"))
    none = dash.sales_page_datasets(marts.sales.limit(0))
    assert _rows(none["kpis"]) == _rows(dash.sales_kpis(marts.sales.limit(0))) and none["months"].count() == 0


@pytest.mark.parametrize("segment", [None, "VIP", "TOP_TIER", "REGULAR"])
def test_customers_page_from_marts_equals_single_datasets(spark, marts, segment):
    from vitrine.sources.warehouse import MartSource

    ranked, lean = marts.customers, build_marts(marts.raw)
    for source in (lean, MartSource(spark, marts=build_marts(marts.raw)), ranked):
        got = dash.customers_page_datasets(source, segment)
        assert _rows(got["kpis"]) == _rows(dash.customer_kpis(ranked))
        assert _rows(got["customers_by_segment"]) == _rows(dash.customers_by_segment(ranked))
        assert _rows(got["revenue_by_segment"]) == _rows(dash.revenue_by_segment(ranked))
        assert got["top_customers"].collect() == dash.top_customers(ranked).collect()
        assert got["customers_by_state"].collect() == dash.customers_by_state(ranked).collect()
        assert got["table"].collect() == dash.customer_table(ranked, segment).collect()
        assert dict(got["kpis"].dtypes) == dict(dash.customer_kpis(ranked).dtypes)
    assert ("customers" in vars(lean)) == (segment in (None, "REGULAR"))     # else nobody else is ranked


def test_customers_page_reads_the_sales_once_and_ranks_nobody(marts):
    vendas, seen = _counting(marts.raw.vendas)
    lean = build_marts(replace(marts.raw, vendas=vendas))
    got = dash.customers_page_datasets(lean, with_table=False)
    assert "table" not in got
    for df in got.values():
        df.collect()
    assert seen.value == marts.raw.vendas.count() and "customers" not in vars(lean)
    dash.customers_page_datasets(lean)["table"].collect()
    assert seen.value == marts.raw.vendas.count()


def test_report_refuses_repeated_dimension_keys(spark, marts):
    from vitrine.sources.tables import ContractViolation

    twice = build_marts(replace(marts.raw, produtos=marts.raw.produtos.union(marts.raw.produtos)))
    with pytest.raises(ContractViolation, match="produtos"):
        rep.run_report(spark, twice)


def test_other_page_bundles(marts):
    c = dash.customers_page_datasets(marts.customers, "VIP")
    assert c["table"].count() == 2 and c["kpis"].first().total_clientes == 4
    p = dash.pricing_page_datasets(marts.pricing, ["moda"])
    assert p["kpis"].first().total_produtos == 1 and p["alerts"].count() == 1
    assert p["categories"].count() == 2


def test_lean_sales_bases_give_the_same_datasets(marts):
    full, facts, prods = marts.sales, marts.sales_facts, marts.sales_with_products
    assert "nome_cliente" not in facts.columns and "categoria" not in facts.columns
    assert "categoria" in prods.columns and "nome_cliente" not in prods.columns
    for fn in (dash.revenue_by_day, dash.revenue_by_weekday, dash.sales_by_hour,
               dash.revenue_by_channel, dash.sales_months, dash.daily_grain_kpis,
               lambda s: dash.sales_kpis(dash.sales_page(s, 2)),
               lambda s: rep.sales_last_days(s, days=2)):
        assert _rows(fn(facts)) == _rows(fn(full))
    assert _rows(dash.top_categories(prods)) == _rows(dash.top_categories(full))
    assert _rows(dash.customers_by_state(marts.customer_base)) == \
        _rows(dash.customers_by_state(marts.customers))


def test_persisted_marts_give_the_same_results(marts):
    before = _rows(dash.revenue_by_day(marts.sales))
    marts.persist("sales", "sales")
    assert marts.sales.storageLevel.useDisk and len(marts._persisted) == 1
    assert _rows(dash.revenue_by_day(marts.sales)) == before
    marts.unpersist()
    assert not marts.sales.storageLevel.useMemory


def test_report_keeps_the_callers_persisted_marts(spark, marts):
    marts.persist("sales", "pricing")
    rep.run_report(spark, marts)
    assert marts.is_persisted("sales") and marts.is_persisted("pricing")
    marts.unpersist()
    rep.run_report(spark, marts)
    assert not marts.is_persisted("pricing")


def test_errors_are_kept_in_their_own_dataset(spark, marts, scratch):
    sections = {"boa": lambda m: spark.range(2), "quebrada": lambda m: spark.sql("SELECT * FROM no_such_table")}
    for day in (1, 2, 2):                                       # the second day twice
        rep.write_report(rep.run_report(spark, marts, sections), scratch, dt.date(2024, 5, day))
    errors = spark.read.parquet(f"{scratch}/{rep.ERRORS}").collect()
    assert sorted((r.data_relatorio.day, r.secao) for r in errors) == [(1, "quebrada"), (2, "quebrada")]
    assert all("no_such_table" in r.erro for r in errors)
    assert spark.read.parquet(f"{scratch}/boa").columns == ["id", "data_relatorio"]
