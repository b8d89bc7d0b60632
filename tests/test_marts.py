"""Hand fixtures for the three marts (FIXTURES.md §3)."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from tests.fixtures import customer, obs, product, raw, sale
from vitrine.plans import marts as mt


def test_weekday_names_sunday_first(spark):
    days = [f"2024-01-{d:02d} 10:00:00" for d in range(7, 14)]   # Sunday .. Saturday
    r = raw(spark, vendas=[sale(i, d) for i, d in enumerate(days)],
            clientes=[customer("c1")], produtos=[product("p1")])
    got = {(row.data_venda.isoformat(), row.dia_semana_nome, row.dia_semana_num)
           for row in mt.sales_enriched(r).collect()}
    assert got == {
        ("2024-01-07", "Domingo", 1), ("2024-01-08", "Segunda", 2), ("2024-01-09", "Terça", 3),
        ("2024-01-10", "Quarta", 4), ("2024-01-11", "Quinta", 5), ("2024-01-12", "Sexta", 6),
        ("2024-01-13", "Sábado", 7),
    }


def test_calendar_parts_and_revenue(spark):
    r = raw(spark, vendas=[sale(1, "2023-11-05 17:45:00", qty=3, price="19.99")],
            clientes=[customer("c1")], produtos=[product("p1", categoria="toys", marca="acme")])
    row = mt.sales_enriched(r).collect()[0]
    assert (row.ano_venda, row.mes_venda, row.hora_venda) == (2023, 11, 17)
    assert row.receita_total == D("59.97")
    assert (row.categoria, row.marca, row.nome_cliente, row.estado) == ("toys", "acme", "Cliente c1", "SP")


def test_orphan_sale_is_kept_with_null_dimensions(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="ghost", produto="nothing")],
            clientes=[customer("c1")], produtos=[product("p1")])
    rows = mt.sales_mart(r, True).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.id_cliente == "ghost" and row.nome_cliente is None and row.estado is None
    assert row.id_produto == "nothing" and row.nome_produto is None and row.categoria is None
    assert row.total_vendas == 1 and row.total_clientes_unicos == 1


def test_daily_context(spark):
    r = raw(spark, vendas=[
        sale(1, "2024-01-01 08:00:00", cliente="a", price="10.00"),
        sale(2, "2024-01-01 09:00:00", cliente="a", price="20.00"),
        sale(3, "2024-01-01 23:00:00", cliente="b", price="33.00"),
        sale(4, "2024-01-02 00:30:00", cliente="b", price="5.00"),
    ], clientes=[customer("a"), customer("b")], produtos=[product("p1")])
    got = {row.id_venda: (row.total_vendas, row.total_clientes_unicos, row.ticket_medio)
           for row in mt.sales_mart(r, True).collect()}
    assert got == {"1": (3, 2, 21.0), "2": (3, 2, 21.0), "3": (3, 2, 21.0), "4": (1, 1, 5.0)}


def test_customer_without_sales_is_regular_without_rank(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="a")],
            clientes=[customer("a"), customer("lonely")], produtos=[product("p1")])
    rows = {row.id_cliente: row for row in mt.customer_mart(r).collect()}
    assert rows["lonely"].ranking_receita is None
    assert rows["lonely"].receita_total is None and rows["lonely"].total_compras is None
    assert rows["lonely"].segmento_cliente == "REGULAR"
    assert rows["a"].ranking_receita == 1 and rows["a"].segmento_cliente == "VIP"


def test_segment_edges_at_ranks_10_11_25_26(spark):
    # customer k spends 1000 - k, so ranks follow k
    ids = [f"c{k:02d}" for k in range(1, 27)]
    vendas = [sale(k, "2024-01-01 10:00:00", cliente=ids[k - 1], price=f"{1000 - k}.00")
              for k in range(1, 27)]
    r = raw(spark, vendas=vendas, clientes=[customer(i) for i in ids], produtos=[product("p1")])
    rows = {row.ranking_receita: row.segmento_cliente for row in mt.customer_mart(r).collect()}
    assert rows[1] == rows[10] == "VIP"
    assert rows[11] == rows[25] == "TOP_TIER"
    assert rows[26] == "REGULAR"
    assert sorted(rows) == list(range(1, 27))


def test_equal_revenue_ranks_by_customer_id(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="b", price="50.00"),
                           sale(2, "2024-01-01 10:00:00", cliente="a", price="50.00"),
                           sale(3, "2024-01-01 10:00:00", cliente="c", price="60.00")],
            clientes=[customer("a"), customer("b"), customer("c")], produtos=[product("p1")])
    ranks = {row.id_cliente: row.ranking_receita for row in mt.customer_mart(r).collect()}
    assert ranks == {"c": 1, "a": 2, "b": 3}


def test_missing_buyer_uses_up_a_rank(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="ghost", price="99.00"),
                           sale(2, "2024-01-01 10:00:00", cliente="a", price="10.00")],
            clientes=[customer("a")], produtos=[product("p1")])
    rows = mt.customer_mart(r).collect()
    assert [(x.id_cliente, x.ranking_receita) for x in rows] == [("a", 2)]


def test_customer_stats_distinct_purchases_and_ticket(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="a", price="10.00"),
                           sale(1, "2024-01-01 10:00:00", cliente="a", price="20.00"),
                           sale(2, "2024-01-02 10:00:00", cliente="a", qty=2, price="15.00")],
            clientes=[customer("a")], produtos=[product("p1")])
    row = mt.customer_stats(r).collect()[0]
    assert row.receita_total == D("60.00") and row.total_compras == 2 and row.ticket_medio == 20.0


def _pricing(spark, produtos, precos, vendas=()):
    r = raw(spark, vendas=vendas, clientes=[customer("c1")], produtos=produtos, precos=precos)
    return {row.id_produto: row for row in mt.pricing_mart(r).collect()}


def test_only_latest_price_per_competitor_counts(spark):
    got = _pricing(spark, [product("p", "10.00")], [
        obs("p", "A", "5.00", "2024-01-01 00:00:00"),
        obs("p", "A", "7.00", "2024-03-01 00:00:00"),
        obs("p", "A", "50.00", "2024-02-01 00:00:00"),
    ])["p"]
    assert got.preco_minimo_concorrentes == got.preco_maximo_concorrentes == D("7.00")
    assert got.qtd_concorrentes == 1 and got.preco_medio_concorrentes == 7.0
    assert got.classificacao_preco == "MAIS_CARO_QUE_TODOS"


def test_five_price_classes(spark):
    comp = lambda p: [obs(p, "A", "10.00", "2024-01-01 00:00:00"),
                      obs(p, "B", "20.00", "2024-01-01 00:00:00"),
                      obs(p, "C", "30.00", "2024-01-01 00:00:00")]
    prices = {"caro": "31.00", "acima": "25.00", "media": "20.00", "abaixo": "15.00", "barato": "9.00"}
    got = _pricing(spark, [product(k, v) for k, v in prices.items()],
                   [o for k in prices for o in comp(k)])
    assert {k: r.classificacao_preco for k, r in got.items()} == {
        "caro": "MAIS_CARO_QUE_TODOS", "acima": "ACIMA_DA_MEDIA", "media": "NA_MEDIA",
        "abaixo": "ABAIXO_DA_MEDIA", "barato": "MAIS_BARATO_QUE_TODOS"}
    assert got["caro"].diferenca_percentual_vs_media == 55.0
    assert got["abaixo"].diferenca_percentual_vs_media == -25.0
    assert got["media"].diferenca_percentual_vs_media == 0.0


def test_max_wins_over_average_when_both_hold(spark):
    # above max is tested first even though it is also above the average
    got = _pricing(spark, [product("p", "12.00")], [obs("p", "A", "10.00", "2024-01-01 00:00:00"),
                                                    obs("p", "B", "11.00", "2024-01-01 00:00:00")])
    assert got["p"].classificacao_preco == "MAIS_CARO_QUE_TODOS"


def test_zero_competitor_average_gives_null_gap(spark):
    got = _pricing(spark, [product("p", "10.00")], [obs("p", "A", "0.00", "2024-01-01 00:00:00")])
    assert got["p"].diferenca_percentual_vs_media is None
    assert got["p"].classificacao_preco == "MAIS_CARO_QUE_TODOS"


def test_price_equal_to_inexact_average_is_at_average(spark):
    # 0.10 + 0.20 + 0.30 = 0.60 -> average 0.2, which is not exact in binary
    got = _pricing(spark, [product("p", "0.20")], [obs("p", "A", "0.10", "2024-01-01 00:00:00"),
                                                   obs("p", "B", "0.20", "2024-01-01 00:00:00"),
                                                   obs("p", "C", "0.30", "2024-01-01 00:00:00")])
    assert got["p"].classificacao_preco == "NA_MEDIA"
    assert got["p"].diferenca_percentual_vs_media == 0.0


def test_product_without_sales_and_without_competitor(spark):
    got = _pricing(spark, [product("sold", "10.00"), product("unsold", "10.00"),
                           product("unwatched", "10.00")],
                   [obs("sold", "A", "10.00", "2024-01-01 00:00:00"),
                    obs("unsold", "A", "10.00", "2024-01-01 00:00:00")],
                   vendas=[sale(1, "2024-01-01 10:00:00", produto="sold", qty=4, price="9.00")])
    assert set(got) == {"sold", "unsold"}
    assert (got["sold"].quantidade_total, got["sold"].receita_total) == (4, D("36.00"))
    assert (got["unsold"].quantidade_total, got["unsold"].receita_total) == (0, D("0.00"))


def test_empty_sales(spark):
    r = raw(spark, clientes=[customer("a")], produtos=[product("p")])
    assert mt.sales_mart(r, True).count() == 0
    assert [x.segmento_cliente for x in mt.customer_mart(r).collect()] == ["REGULAR"]
    assert mt.pricing_mart(r).count() == 0
    assert mt.customer_stats(r).where(F.col("id_cliente").isNotNull()).count() == 0


def test_segment_mart_equals_full_mart(spark):
    ids = [f"c{k:02d}" for k in range(1, 31)]
    vendas = [sale(k, "2024-01-01 10:00:00", cliente=ids[k % 30], price=f"{(k * 37) % 50 + 1}.00")
              for k in range(1, 200)] + [sale(999, "2024-01-01 10:00:00", cliente="ghost", price="999.00")]
    r = raw(spark, vendas=vendas, clientes=[customer(i) for i in ids + ["lonely"]],
            produtos=[product("p1")])
    full = {x.id_cliente: (x.segmento_cliente, x.receita_total, x.total_compras)
            for x in mt.customer_mart(r).collect()}
    seg = {x.id_cliente: (x.segmento_cliente, x.receita_total, x.total_compras)
           for x in mt.customer_segment_mart(r).collect()}
    assert full == seg
    assert sum(v[0] == "VIP" for v in seg.values()) == 9          # ghost holds rank 1
