"""Datasets behind the three dashboard pages (sales, customers, pricing).

The dashboard grouped with pandas, which drops NULL group keys; every grouped
dataset here filters its key to non-NULL first for the same result. Filters
and aggregations run in the plan; only the small results are meant to be
collected by a front end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.calendar import month_label, weekday_order
from vitrine.functions.formatting import (
    brl, brl_or_dash, decimal_pattern, signed_percent, thousands,
)
from vitrine.plans.marts import mean
from vitrine.plans.reports import AVERAGE_DIGITS, exact_mean_2dp
from vitrine.schemas import (
    CLASS_CHEAPER_THAN_ALL, CLASS_MORE_EXPENSIVE_THAN_ALL, CUSTOMER_TABLE_NAMES,
    DASHBOARD_TOP_CATEGORIES, DASHBOARD_TOP_CUSTOMERS, MONEY, PRICE_ALERT_NAMES, SEGMENT_TOP, SEGMENT_VIP,
)


def _sum_or_zero(col: str | F.Column) -> F.Column:
    return F.coalesce(F.sum(col).cast(MONEY), F.lit(0).cast(MONEY))


def _grouped(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


# ------------------------------------------------------------------ sales page
def sales_page(sales: DataFrame, month: int | None = None) -> DataFrame:
    """The sales rows of the page; ``month`` = None means all months."""
    return sales if month is None else sales.where(F.col("mes_venda") == month)


def sales_kpis(sales: DataFrame) -> DataFrame:
    """Revenue, number of sales, mean ticket (0 when empty), distinct customers."""
    return _formatted_kpis(sales.agg(
        _sum_or_zero("receita_total").alias("receita_total"),
        F.count(F.lit(1)).alias("total_vendas"),
        F.coalesce(mean("receita_total"), F.lit(0.0)).alias("ticket_medio"),
        F.countDistinct("id_cliente").alias("clientes_unicos"),
    ))


def _formatted_kpis(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "*",
        brl(F.col("receita_total")).alias("receita_total_fmt"),
        thousands(F.col("total_vendas")).alias("total_vendas_fmt"),
        brl(F.col("ticket_medio")).alias("ticket_medio_fmt"),
        thousands(F.col("clientes_unicos")).alias("clientes_unicos_fmt"),
    )


def sales_months(sales: DataFrame) -> DataFrame:
    """Months present, ascending, with their short label."""
    return (_grouped(sales, "mes_venda").select("mes_venda").distinct()
            .select("mes_venda", month_label(F.col("mes_venda")).alias("mes_label"))
            .orderBy("mes_venda"))


def revenue_by_day(sales: DataFrame) -> DataFrame:
    return (_grouped(sales, "data_venda").groupBy("data_venda")
            .agg(_sum_or_zero("receita_total").alias("receita_total"))
            .orderBy("data_venda"))


def revenue_by_weekday(sales: DataFrame) -> DataFrame:
    """Revenue per weekday name, Monday first; names outside the week last."""
    return (_grouped(sales, "dia_semana_nome").groupBy("dia_semana_nome")
            .agg(_sum_or_zero("receita_total").alias("receita_total"))
            .orderBy(weekday_order(F.col("dia_semana_nome")).asc_nulls_last(), "dia_semana_nome"))


def sales_by_hour(sales: DataFrame) -> DataFrame:
    """Number of sales (non-NULL ids) per hour of the day."""
    return (_grouped(sales, "hora_venda").groupBy("hora_venda")
            .agg(F.count("id_venda").alias("vendas")).orderBy("hora_venda"))


def revenue_by_channel(sales: DataFrame) -> DataFrame:
    return (_grouped(sales, "canal_venda").groupBy("canal_venda")
            .agg(_sum_or_zero("receita_total").alias("receita_total")))


def top_categories(sales: DataFrame, n: int = DASHBOARD_TOP_CATEGORIES) -> DataFrame:
    """The ``n`` categories with most revenue (ties: name), shown ascending."""
    top = (_grouped(sales, "categoria").groupBy("categoria")
           .agg(_sum_or_zero("receita_total").alias("receita_total"))
           .orderBy(F.col("receita_total").desc(), F.col("categoria").asc()).limit(n))
    return top.orderBy(F.col("receita_total").asc(), F.col("categoria").desc())


def daily_grain_kpis(sales: DataFrame) -> DataFrame:
    """KPIs as documented on a daily grain: sales per day summed, revenue over
    sales, largest and summed daily distinct customers."""
    daily = sales.groupBy("data_venda").agg(
        F.count(F.lit(1)).alias("total_vendas"),
        F.countDistinct("id_cliente").alias("total_clientes_unicos"),
        F.sum("receita_total").cast(MONEY).alias("receita"),
    )
    return daily.agg(
        _sum_or_zero("receita").alias("receita_total"),
        F.coalesce(F.sum("total_vendas"), F.lit(0).cast("bigint")).alias("total_vendas"),
        F.try_divide(F.sum("receita").cast("double"), F.sum("total_vendas")).alias("ticket_medio"),
        F.max("total_clientes_unicos").alias("clientes_max_dia"),
        F.sum("total_clientes_unicos").alias("clientes_soma_dias"),
        F.count(F.lit(1)).alias("dias"),
    )


def daily_grain_sales_by_hour(sales: DataFrame) -> DataFrame:
    """The documented hourly chart on its proper grain: sales per (day, hour)
    first, then summed per hour (on the per-sale mart, summing the per-day
    count would multiply it). Equals :func:`sales_by_hour`."""
    hourly = (_grouped(sales, "hora_venda").groupBy("data_venda", "hora_venda")
              .agg(F.count("id_venda").alias("vendas")))
    return (hourly.groupBy("hora_venda").agg(F.sum("vendas").alias("vendas"))
            .orderBy("hora_venda"))


# -------------------------------------------------------------- customers page
def customer_kpis(customers: DataFrame) -> DataFrame:
    is_vip = F.col("segmento_cliente") == SEGMENT_VIP
    return customers.agg(
        F.count(F.lit(1)).alias("total_clientes"),
        F.count_if(is_vip).alias("clientes_vip"),
        F.coalesce(F.sum(F.when(is_vip, F.col("receita_total"))).cast(MONEY),
                   F.lit(0).cast(MONEY)).alias("receita_vip"),
        F.round(F.avg("ticket_medio"), AVERAGE_DIGITS).alias("ticket_medio_geral"),
    )


def customers_by_segment(customers: DataFrame) -> DataFrame:
    return (_grouped(customers, "segmento_cliente").groupBy("segmento_cliente")
            .agg(F.count(F.lit(1)).alias("clientes")))


def revenue_by_segment(customers: DataFrame) -> DataFrame:
    return (_grouped(customers, "segmento_cliente").groupBy("segmento_cliente")
            .agg(_sum_or_zero("receita_total").alias("receita_total")))


def top_customers(customers: DataFrame, n: int = DASHBOARD_TOP_CUSTOMERS) -> DataFrame:
    """The ``n`` best-ranked customers present in the mart, shown by revenue.

    ``customers`` is a mart with ranks, or already the list that
    ``Marts.top_customers(n)`` finds without ranking everyone.
    """
    top = (customers.where(F.col("ranking_receita").isNotNull())
           .orderBy("ranking_receita").limit(n)
           .select("ranking_receita", "id_cliente", "nome_cliente", "receita_total"))
    return top.orderBy(F.col("receita_total").asc_nulls_first(), F.col("ranking_receita").desc())


def customers_by_state(customers: DataFrame) -> DataFrame:
    return (_grouped(customers, "estado").groupBy("estado")
            .agg(F.count(F.lit(1)).alias("clientes"))
            .orderBy(F.col("clientes").desc(), F.col("estado").asc()))


def customer_table(customers: DataFrame, segment: str | None = None) -> DataFrame:
    """Detail table by rank, display names and Brazilian money format."""
    df = customers if segment is None else customers.where(F.col("segmento_cliente") == segment)
    shown = {"receita_total": brl_or_dash, "ticket_medio": brl_or_dash}
    return df.orderBy(F.col("ranking_receita").asc_nulls_last(), F.col("id_cliente")).select(*[
        shown.get(column, lambda c: c)(F.col(column)).alias(name)
        for column, name in CUSTOMER_TABLE_NAMES.items()])


# ---------------------------------------------------------------- pricing page
def pricing_page(pricing: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Products of the chosen categories; an empty choice means no filter.

    A non-empty choice drops products without category, as the page did.
    """
    return pricing.where(F.col("categoria").isin(list(categories))) if categories else pricing


def price_categories(pricing: DataFrame) -> DataFrame:
    return _grouped(pricing, "categoria").select("categoria").distinct().orderBy("categoria")


def pricing_kpis(pricing: DataFrame) -> DataFrame:
    klass = F.col("classificacao_preco")
    return pricing.agg(
        F.count(F.lit(1)).alias("total_produtos"),
        F.count_if(klass == CLASS_MORE_EXPENSIVE_THAN_ALL).alias("mais_caros"),
        F.count_if(klass == CLASS_CHEAPER_THAN_ALL).alias("mais_baratos"),
        exact_mean_2dp("diferenca_percentual_vs_media").alias("dif_media"),
    ).withColumn("dif_media_fmt", signed_percent(F.col("dif_media")))


def products_by_price_class(pricing: DataFrame) -> DataFrame:
    return (_grouped(pricing, "classificacao_preco").groupBy("classificacao_preco")
            .agg(F.count(F.lit(1)).alias("produtos")))


def price_gap_by_category(pricing: DataFrame) -> DataFrame:
    """Mean gap per category, ascending, with the sign used for coloring."""
    gap = F.col("dif_media")
    return (_grouped(pricing, "categoria").groupBy("categoria")
            .agg(exact_mean_2dp("diferenca_percentual_vs_media").alias("dif_media"))
            .withColumn("sinal", F.when(gap < 0, F.lit("mais_barato")).otherwise(F.lit("mais_caro")))
            .orderBy(gap.asc_nulls_last(), "categoria"))


def price_vs_volume(pricing: DataFrame) -> DataFrame:
    """Scatter data: gap, units, class, revenue, name, own and mean competitor price."""
    return pricing.select(
        "id_produto", "diferenca_percentual_vs_media", "quantidade_total",
        "classificacao_preco", "receita_total", "nome_produto", "nosso_preco",
        "preco_medio_concorrentes",
    )


def price_alerts(pricing: DataFrame) -> DataFrame:
    """Products dearer than every competitor, largest gap first, formatted."""
    gap = F.col("diferenca_percentual_vs_media")
    shown = {"nosso_preco": brl, "preco_maximo_concorrentes": brl, "receita_total": brl,
             "diferenca_percentual_vs_media":
                 lambda c: F.concat(F.lit("+"), decimal_pattern(c, "0.0"), F.lit("%"))}
    return (
        pricing.where(F.col("classificacao_preco") == CLASS_MORE_EXPENSIVE_THAN_ALL)
        .orderBy(gap.desc_nulls_last(), F.col("id_produto"))
        .select(*[shown.get(column, lambda c: c)(F.col(column)).alias(name)
                  for column, name in PRICE_ALERT_NAMES.items()])
    )


# ------------------------------------------------------------ page bundles
_SALES_KEYS = ("data_venda", "dia_semana_nome", "hora_venda", "canal_venda", "categoria", "mes_venda", "id_cliente")


def grouped_once(df: DataFrame, keys: Sequence[str], totals: Sequence[F.Column]) -> DataFrame:
    """``totals`` per value of each of ``keys``, in one aggregation over ``df``.

    ``GROUPING SETS`` expands each row once per key inside the partial aggregate, so the rows
    are scanned and shuffled once instead of once per key. ``grupo`` names the key of a row.
    """
    columns = [F.col(k) for k in keys]
    full, which = (1 << len(keys)) - 1, F.lit(None).cast("string")
    for i, k in enumerate(keys):
        which = F.when(F.col("_gid") == full - (1 << (len(keys) - 1 - i)), F.lit(k)).otherwise(which)
    return (df.groupingSets([[k] for k in columns], *columns)
            .agg(*totals, F.grouping_id(*columns).alias("_gid"))
            .withColumn("grupo", which).drop("_gid"))


def sales_page_totals(sales: DataFrame, month: int | None = None) -> DataFrame:
    """What every dataset of the sales page is made of, from one scan of the sales.

    Rows of other months add nothing to the totals and only show that their month is there. The
    group of a customer is that customer's sales, so the distinct count is a count of such
    groups: customers are merged before the shuffle, as a distinct count would do, and no second
    pass is needed. The result has one row per customer, and one per distinct value of the
    other keys.
    """
    here = F.lit(True) if month is None else F.coalesce(F.col("mes_venda") == month, F.lit(False))
    rows = sales.select(*_SALES_KEYS, "receita_total", "id_venda", here.alias("_here"))
    inside = lambda c: F.when(F.col("_here"), c)                          # noqa: E731
    return grouped_once(rows, _SALES_KEYS, [
        _sum_or_zero(inside(F.col("receita_total"))).alias("receita_total"),
        F.count(inside(F.col("id_venda"))).alias("vendas"),
        F.count(inside(F.col("receita_total"))).alias("tickets"),
        F.count(inside(F.lit(1))).alias("linhas")])


def sales_page_datasets(sales: DataFrame, month: int | None = None, prune: bool = False) -> dict[str, DataFrame]:
    """Every dataset of the sales page for one month filter.

    The page reads product categories but no customer attribute, so pass
    ``Marts.sales_with_products`` (or the loaded table) rather than the full
    mart. All seven datasets come from one materialized ``sales_page_totals``, one scan of
    the sales. ``prune`` is for a table partitioned by month: the month's partitions alone are
    read for the totals, and the partition column for the months.
    """
    from vitrine.operators.materialize import materialize

    pruned = prune and month is not None
    totals = materialize(sales_page_totals(sales_page(sales, month) if pruned else sales, month), "sales-page")

    def part(key: str) -> DataFrame:
        return totals.where((F.col("grupo") == key) & F.col(key).isNotNull() & (F.col("linhas") > 0))

    buyers = totals.where(F.col("grupo") == "id_cliente")
    kpis = buyers.agg(
        _sum_or_zero("receita_total").alias("receita_total"),
        F.coalesce(F.sum("linhas"), F.lit(0).cast("bigint")).alias("total_vendas"),
        F.coalesce(F.try_divide(F.sum("receita_total").cast("double"), F.sum("tickets")),
                   F.lit(0.0)).alias("ticket_medio"),
        F.count_if(F.col("id_cliente").isNotNull() & (F.col("linhas") > 0)).alias("clientes_unicos"))
    months = totals.where(F.col("grupo") == "mes_venda")
    top = (part("categoria").orderBy(F.col("receita_total").desc(), F.col("categoria").asc())
           .limit(DASHBOARD_TOP_CATEGORIES))
    return {
        "kpis": _formatted_kpis(kpis),
        "months": sales_months(sales if pruned else months),
        "revenue_by_day": part("data_venda").select("data_venda", "receita_total").orderBy("data_venda"),
        "revenue_by_weekday": part("dia_semana_nome").select("dia_semana_nome", "receita_total")
        .orderBy(weekday_order(F.col("dia_semana_nome")).asc_nulls_last(), "dia_semana_nome"),
        "sales_by_hour": part("hora_venda").select("hora_venda", "vendas").orderBy("hora_venda"),
        "revenue_by_channel": part("canal_venda").select("canal_venda", "receita_total"),
        "top_categories": top.select("categoria", "receita_total")
        .orderBy(F.col("receita_total").asc(), F.col("categoria").desc()),
    }


_CUSTOMER_KEYS = ("segmento_cliente", "estado")


def customers_page_datasets(customers, segment: str | None = None, with_table: bool = True) -> dict[str, DataFrame]:
    """Every dataset of the customers page; ``segment`` filters the detail table.

    ``customers`` is a ``Marts``, a ``MartSource``, or a customer mart with ranks. The KPIs and the three
    charts come from one grouping-sets pass, whose few rows are written. From local marts the
    per-customer stats are computed once for the whole page; the best customers, and the table of a segment
    that ranks decide, are a top-k of them. Everyone is ranked only for a table that shows everyone (or
    the last segment); a front end that does not show it leaves it out by ``with_table``.
    """
    from vitrine.operators.materialize import materialize

    if isinstance(customers, DataFrame):
        mart, best, table = customers, top_customers(customers), lambda: customers
    else:
        local = getattr(customers, "marts", None) if getattr(customers, "mode", "local") == "local" else None
        marts = local or customers
        if hasattr(marts, "top_customers"):                       # built here
            mart = marts.customer_segments                       # which has the stats written
            best = top_customers(marts.top_customers(DASHBOARD_TOP_CUSTOMERS))
            table = lambda: marts.best_customers if segment in (SEGMENT_VIP, SEGMENT_TOP) else marts.customers
        else:
            mart = marts.customers
            best, table = top_customers(mart), lambda: mart
    totals = materialize(grouped_once(mart.select(*_CUSTOMER_KEYS, "receita_total", "ticket_medio"), _CUSTOMER_KEYS, [
        F.count(F.lit(1)).alias("clientes"), _sum_or_zero("receita_total").alias("receita_total"),
        F.sum("ticket_medio").alias("tickets"), F.count("ticket_medio").alias("com_ticket")]), "customers-page")
    by_segment, is_vip = totals.where(F.col("grupo") == "segmento_cliente"), F.col("segmento_cliente") == SEGMENT_VIP
    zero = F.lit(0).cast("bigint")
    out = {
        "kpis": by_segment.agg(
            F.coalesce(F.sum("clientes"), zero).alias("total_clientes"),
            F.coalesce(F.sum(F.when(is_vip, F.col("clientes"))), zero).alias("clientes_vip"),
            _sum_or_zero(F.when(is_vip, F.col("receita_total"))).alias("receita_vip"),
            F.round(F.try_divide(F.sum("tickets").cast("double"), F.sum("com_ticket")), AVERAGE_DIGITS)
            .alias("ticket_medio_geral")),
        "customers_by_segment": _grouped(by_segment, "segmento_cliente").select("segmento_cliente", "clientes"),
        "revenue_by_segment": _grouped(by_segment, "segmento_cliente").select("segmento_cliente", "receita_total"),
        "top_customers": best,
        "customers_by_state": _grouped(totals.where(F.col("grupo") == "estado"), "estado")
        .select("estado", "clientes").orderBy(F.col("clientes").desc(), F.col("estado").asc()),
    }
    return out | ({"table": customer_table(table(), segment)} if with_table else {})


def pricing_page_datasets(pricing: DataFrame,
                          categories: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every dataset of the pricing page for one category choice.

    The mart is written once to the checkpoint folder (one row per product) and all
    six datasets read it there.
    """
    from vitrine.operators.materialize import materialize

    pricing = materialize(pricing, "pricing-page")
    page = pricing_page(pricing, categories)
    return {
        "categories": price_categories(pricing),
        "kpis": pricing_kpis(page),
        "products_by_price_class": products_by_price_class(page),
        "price_gap_by_category": price_gap_by_category(page),
        "price_vs_volume": price_vs_volume(page),
        "alerts": price_alerts(page),
    }
