
from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vitrine.operators.ranking import global_row_number
from vitrine.plans import marts as mt
from vitrine.sources.raw import RawTables, read_raw
from vitrine.sources.testdata import raw_from_testdata

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "PythonMapInArrow")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_share", [0.0, 0.34])
def test_scalable_rank_equals_plain_window(spark, hot_share):
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        r = rnd.random()
        rev = None if r < 0.05 else (500 if r < 0.05 + hot_share else rnd.randint(0, 300))
        rows.append((f"id{rnd.randint(0, 10**9):010d}-{i}", rev))
    df = spark.createDataFrame(rows, "k string, rev int").repartition(13)
    order = [F.col("rev").desc_nulls_last(), F.col("k").asc_nulls_last()]
    ours = {r.k: r.rn for r in global_row_number(df, order, "rn").collect()}
    plain = {r.k: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    assert ours == plain


def test_rank_plan_has_no_global_window_on_rows(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    ranked = global_row_number(df, [F.col("v").desc(), F.col("k")], "rn")
    text = plan_text(ranked)
    assert "row_number" not in text
    assert "BroadcastHashJoin" in text or "BroadcastExchange" in text


def test_latest_price_uses_group_limit(spark):
    text = plan_text(mt.latest_competitor_prices(raw_from_testdata(spark, SF)))
    assert text.count("WindowGroupLimit") >= 2          # before and after the shuffle


def test_no_python_udf_in_any_registered_query(spark):
    for name, fn in entry.queries().items():
        if re.match(r"op\d+_|pipeline$", name):        # text operators: see their own tests
            continue
        text = plan_text(fn(spark, SF))
        assert not any(node in text for node in PYTHON_NODES), name


def test_properties_on_driver_tables(spark):
    raw = raw_from_testdata(spark, SF)
    marts = mt.build_marts(raw, with_daily_context=True)
    sales, customers, pricing = marts.sales, marts.customers, marts.pricing
    assert sales.count() == raw.vendas.count()
    total = sales.agg(F.sum("receita_total")).first()[0]
    daily = sales.groupBy("data_venda").agg(F.sum("receita_total").alias("r")).agg(F.sum("r")).first()[0]
    assert total == daily
    seg = {r.segmento_cliente: r["count"] for r in customers.groupBy("segmento_cliente").count().collect()}
    assert set(seg) <= {"VIP", "TOP_TIER", "REGULAR"}
    assert sum(seg.values()) == customers.count() == raw.clientes.count()
    assert pricing.join(raw.produtos, "id_produto", "left_anti").count() == 0
    assert pricing.select("id_produto").distinct().count() == pricing.count()
    # per-day context equals a direct per-day count on every row
    direct = sales.groupBy("data_venda").agg(F.count(F.lit(1)).alias("n"))
    joined = sales.select("data_venda", "total_vendas").distinct().join(direct, "data_venda")
    assert joined.where(F.col("n") != F.col("total_vendas")).count() == 0


def test_raw_scan_prunes_columns_and_pushes_filters(spark, scratch):
    raw = raw_from_testdata(spark, SF)
    for name, df in raw.as_dict().items():
        df.select(*[c for c in df.columns if not c.startswith("l_")]).write.parquet(
            f"{scratch}/{name}.parquet")
    r = read_raw(spark, scratch)
    q = r.vendas.where(F.col("id_cliente") == "7").select("id_venda")
    text = plan_text(q)
    assert "PushedFilters: [IsNotNull(id_cliente), EqualTo(id_cliente,7)]" in text
    assert "ReadSchema: struct<id_venda:string,id_cliente:string>" in text


def test_marts_from_raw_files_equal_mapped_marts(spark, scratch):
    mapped = raw_from_testdata(spark, SF)
    for name, df in mapped.as_dict().items():
        df.select(*[c for c in df.columns if not c.startswith("l_")]).write.parquet(
            f"{scratch}/{name}.parquet")
    from_files = read_raw(spark, scratch)
    assert [f.dataType for f in from_files.vendas.schema] == [f.dataType for f in mapped.vendas.schema]

    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    assert rows(mt.sales_mart(from_files, True)) == rows(mt.sales_mart(mapped, True))
    assert rows(mt.customer_mart(from_files)) == rows(mt.customer_mart(mapped))
    # without the observation keys the latest price is broken by price: same products and classes
    a = {r.id_produto for r in mt.pricing_mart(from_files).collect()}
    b = {r.id_produto for r in mt.pricing_mart(mapped).collect()}
    assert a == b


def _joins(df) -> int:
    return sum("Join" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_report_sections_are_the_registered_plans(spark):
    from vitrine.plans import reports as rep
    marts = mt.build_marts(raw_from_testdata(spark, SF))
    twins = {"vendas": "report_sales_last_days", "clientes": "report_segments",
             "pricing": "report_price_classes", "criticos": "report_critical_products"}
    assert set(twins) == set(rep.SECTIONS)
    for section, name in twins.items():
        assert _joins(rep.SECTIONS[section](marts)) == _joins(entry.queries()[name](spark, SF)), section


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_source_row_is_mapped(spark, sf):
    d = f"/root/testdata/{sf}"
    raw, size = raw_from_testdata(spark, d), lambda t: spark.read.parquet(f"{d}/{t}.parquet").count()
    assert raw.vendas.count() == raw.preco_competidores.count() == size("lineitem")
    assert raw.clientes.count() == size("customer") and raw.produtos.count() == size("part")
    # and every NULL branch of the marts is still reached
    sales = mt.sales_enriched(raw)
    assert sales.where("nome_cliente IS NULL").count() and sales.where("nome_produto IS NULL").count()
    assert raw.clientes.join(raw.vendas, "id_cliente", "left_anti").count()
    assert raw.produtos.join(raw.vendas, "id_produto", "left_anti").count()
    assert raw.produtos.join(raw.preco_competidores, "id_produto", "left_anti").count()


@pytest.mark.parametrize("vip,top", [(10, 25), (30, 25), (0, 0), (1, 1000), (1000, 1), (5, 5)])
def test_both_customer_marts_agree_for_any_thresholds(spark, vip, top, monkeypatch):
    raw = raw_from_testdata(spark, SF)
    ranked = mt.customer_mart(raw, vip, top).select("id_cliente", "segmento_cliente")
    expect = sorted(map(tuple, ranked.collect()))
    for bound in (mt.TOP_IN_ONE_TASK, 3):
        monkeypatch.setattr(mt, "TOP_IN_ONE_TASK", bound)
        lean = mt.customer_segment_mart(raw, vip, top).select("id_cliente", "segmento_cliente")
        assert sorted(map(tuple, lean.collect())) == expect


def test_top_customers_need_no_global_rank(spark):
    from vitrine.plans import dashboard as dash
    raw = raw_from_testdata(spark, SF)
    for n in (10, 400):
        lean = dash.top_customers(mt.build_marts(raw).top_customers(n), n).collect()
        assert lean == dash.top_customers(mt.customer_mart(raw), n).collect()
    assert mt.top_customer_ranks(RawTables(raw.vendas.limit(0), raw.clientes, raw.produtos,
                                           raw.preco_competidores), 5).collect() == []


def test_chunks_cost_grows_with_the_length(spark):
    import time

    from vitrine.functions.text import text_chunks

    def seconds(n):
        df = spark.createDataFrame([(0,)], "k int").select(F.repeat(F.lit("é"), n).alias("t"))
        start = time.perf_counter()
        assert text_chunks(df, "t").agg(F.sum(F.length("texto"))).first()[0] == n
        return time.perf_counter() - start

    seconds(10_000)
    small, large = min(seconds(1_000_000) for _ in range(3)), min(seconds(8_000_000) for _ in range(3))
    assert large < 20 * small + 0.5              # 64 times as long if it were quadratic
