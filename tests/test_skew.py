"""A key holding a third of all rows: split by the engine, results unchanged."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from tests.fixtures import customer, product, raw, sale
from tests.test_plans import plan_text
from vitrine.plans import marts as mt

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _hot_raw(spark, n=3000):
    vendas = [sale(i, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00",
                   cliente="hot" if i % 3 == 0 else f"c{i % 97}", produto=f"p{i % 13}",
                   price=f"{1 + i % 50}.00") for i in range(n)]
    clientes = [customer("hot")] + [customer(f"c{k}") for k in range(97)]
    produtos = [product(f"p{k}") for k in range(13)]
    return raw(spark, vendas, clientes, produtos)


def test_hot_customer_join_is_split_and_exact(spark):
    r = _hot_raw(spark)
    with conf(spark, SKEW_CONF):
        df = mt.sales_enriched(r)
        rows = df.collect()
        text = plan_text(df)
    assert "SortMergeJoin(skew=true)" in text
    assert len(rows) == 3000
    assert sum(1 for x in rows if x.id_cliente == "hot") == 1000
    assert all(x.nome_cliente == f"Cliente {x.id_cliente}" for x in rows)


def test_hot_customer_aggregates_are_partial_before_shuffle(spark):
    r = _hot_raw(spark)
    text = plan_text(mt.customer_stats(r))
    # the partial aggregate sits below the first exchange
    lines = text.splitlines()
    first_exchange = next(i for i, line in enumerate(lines[::-1]) if "Exchange" in line)
    below = lines[len(lines) - first_exchange:]
    assert any("HashAggregate" in line for line in below)
    stats = {x.id_cliente: x for x in mt.customer_stats(r).collect()}
    assert stats["hot"].total_compras == 1000


def test_hot_customer_rank_is_exact(spark):
    r = _hot_raw(spark)
    ranks = {x.id_cliente: x.ranking_receita for x in mt.customer_mart(r).collect()}
    stats = mt.customer_stats(r).orderBy(F.col("receita_total").desc(), "id_cliente").collect()
    assert [ranks[s.id_cliente] for s in stats] == list(range(1, len(stats) + 1))


def test_hot_competitor_history_latest_is_exact(spark):
    from tests.fixtures import obs

    precos = [obs("hot", "A", f"{10 + i % 90}.00", f"2020-01-01 00:00:00") for i in range(1500)]
    precos[777] = obs("hot", "A", "42.42", "2021-06-01 00:00:00")             # the newest
    precos += [obs(f"p{i % 50}", f"C{i % 3}", f"{i % 70 + 1}.00", f"2020-{1 + i % 12:02d}-01 00:00:00")
               for i in range(3000)]
    r = raw(spark, produtos=[product("hot")] + [product(f"p{k}") for k in range(50)], precos=precos)
    df = spark.createDataFrame(precos, r.preco_competidores.schema).repartition(7)
    r = r.__class__(vendas=r.vendas, clientes=r.clientes, produtos=r.produtos, preco_competidores=df)
    latest = mt.latest_competitor_prices(r)
    text = plan_text(latest)
    # printed root first: a WindowGroupLimit after the exchange line runs below it, map side
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")
    rows = {(x.id_produto, x.nome_concorrente): x.preco_concorrente for x in latest.collect()}
    assert rows[("hot", "A")] == __import__("decimal").Decimal("42.42")
    assert len(rows) == 1 + len({(f"p{i % 50}", f"C{i % 3}") for i in range(3000)})
