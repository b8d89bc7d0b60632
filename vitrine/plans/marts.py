"""The three gold marts, each defined once.

* sales (``vendas_temporais``): one row per sale, enriched with customer and
  product attributes, calendar parts and optional per-day context;
* customers (``clientes_segmentacao``): one row per customer, revenue stats,
  global revenue rank and segment;
* pricing (``precos_competitividade``): one row per product that has a
  competitor price, position against the latest competitor prices and sales.

Money stays DECIMAL end to end; averages are ``sum / count`` as DOUBLE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.calendar import weekday_name
from vitrine.operators.daily import attach_daily_context, daily_context
from vitrine.operators.latest import latest_per_group
from vitrine.operators.materialize import materialize
from vitrine.operators.pricing import price_class, price_gap_pct
from vitrine.operators.ranking import global_row_number
from vitrine.schemas import (
    MONEY, SEGMENT_REGULAR, SEGMENT_TOP, SEGMENT_VIP, TOP_TIER_MAX_RANK, VIP_MAX_RANK,
)
from vitrine.sources.raw import RawTables


TOP_IN_ONE_TASK = 10_000      # longest list of best buyers that one task numbers


def _revenue() -> Column:
    """Revenue of one sale in the product's own width; sums of it are cast to MONEY."""
    return F.col("quantidade") * F.col("preco_unitario")


def mean(col: str | Column) -> Column:
    """Average as ``sum / count`` in DOUBLE (exact sum, one rounding)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


# ----------------------------------------------------------------- sales mart
SALES_COLUMNS = [
    "id_venda", "data_venda", "ano_venda", "mes_venda", "hora_venda", "dia_semana_num",
    "dia_semana_nome", "canal_venda", "id_cliente", "nome_cliente", "estado",
    "id_produto", "nome_produto", "categoria", "marca", "quantidade", "preco_unitario",
    "receita_total",
]
CUSTOMER_ATTRIBUTES = ["nome_cliente", "estado"]
PRODUCT_ATTRIBUTES = ["nome_produto", "categoria", "marca"]


def sales_facts(raw: RawTables) -> DataFrame:
    """The sales columns that come from the sales rows alone: calendar parts,
    weekday name and revenue (no customer or product attribute)."""
    ts = F.col("data_venda")
    return raw.vendas.select(
        "id_venda",
        ts.cast("date").alias("data_venda"),
        F.year(ts).alias("ano_venda"),
        F.month(ts).alias("mes_venda"),
        F.hour(ts).alias("hora_venda"),
        F.dayofweek(ts).alias("dia_semana_num"),
        weekday_name(ts).alias("dia_semana_nome"),
        "canal_venda", "id_cliente", "id_produto", "quantidade", "preco_unitario",
        _revenue().cast(MONEY).alias("receita_total"),
    )


def sales_enriched(raw: RawTables, customers: bool = True, products: bool = True) -> DataFrame:
    """Sales with customer and product attributes and calendar parts.

    Both dimension joins are LEFT joins, so a sale with an unknown customer or
    product is kept with NULL attributes. No broadcast hint: the planner
    broadcasts a dimension when its size estimate allows, adaptive execution
    re-plans on runtime sizes, and skewed customer or product keys are split by
    the skew-join handling.

    ``customers=False`` / ``products=False`` leave a dimension out (its columns
    are absent). Datasets that read no attribute of a dimension use that form:
    with unique dimension keys (the key contract) the rows and values are the
    same, and on a large cluster it saves a shuffle of every sale per join left
    out, which Catalyst cannot remove on its own because it cannot know the
    keys are unique. ``input_key_violations`` checks that contract.
    """
    df = sales_facts(raw)
    if customers:
        df = df.join(raw.clientes.select("id_cliente", *CUSTOMER_ATTRIBUTES), "id_cliente", "left")
    if products:
        df = df.join(raw.produtos.select("id_produto", *PRODUCT_ATTRIBUTES), "id_produto", "left")
    return df.select(*[c for c in SALES_COLUMNS if c in df.columns])


def sales_daily(raw: RawTables) -> DataFrame:
    """Per-day totals from the raw sales (the dimension joins are not needed)."""
    v = raw.vendas.select(
        F.col("data_venda").cast("date").alias("data_venda"), "id_cliente",
        _revenue().alias("receita_total"))
    return daily_context(v)


def sales_mart(raw: RawTables, with_daily_context: bool = False) -> DataFrame:
    base = sales_enriched(raw)
    if not with_daily_context:
        return base
    return attach_daily_context(base, sales_daily(raw))


# ------------------------------------------------------------- customer mart
def customer_stats(raw: RawTables) -> DataFrame:
    """Per customer id seen in sales: revenue, distinct sales, mean ticket."""
    rev = _revenue()
    return raw.vendas.groupBy("id_cliente").agg(
        F.sum(rev).cast(MONEY).alias("receita_total"),
        F.countDistinct("id_venda").alias("total_compras"),
        mean(rev).alias("ticket_medio"),
    )


def segment(rank: Column, vip_max: int = VIP_MAX_RANK, top_max: int = TOP_TIER_MAX_RANK) -> Column:
    """VIP / TOP_TIER by rank threshold; no rank (no sales) is REGULAR."""
    return (F.when(rank <= vip_max, F.lit(SEGMENT_VIP))
            .when(rank <= top_max, F.lit(SEGMENT_TOP))
            .otherwise(F.lit(SEGMENT_REGULAR)))


def _rank_order() -> list[Column]:
    return [F.col("receita_total").desc_nulls_last(), F.col("id_cliente").asc_nulls_last()]


def _customer_columns(clientes: DataFrame, ranked: DataFrame, vip_max: int, top_max: int) -> DataFrame:
    return clientes.join(ranked, "id_cliente", "left").select(
        "id_cliente", "nome_cliente", "estado", "pais",
        F.col("data_cadastro").cast("date").alias("data_cadastro"),
        "receita_total", "total_compras", "ticket_medio", "ranking_receita",
        segment(F.col("ranking_receita"), vip_max, top_max).alias("segmento_cliente"),
    )


def customer_mart(raw: RawTables, vip_max: int = VIP_MAX_RANK,
                  top_max: int = TOP_TIER_MAX_RANK, stats: DataFrame | None = None) -> DataFrame:
    """Customers with stats, revenue rank and segment.

    Ranks are assigned over every customer id in the sales before the join to
    the customer table (a buyer missing from it still uses up a rank). Rank
    order: revenue descending (NULL last), then customer id. ``stats`` are the rows of
    :func:`customer_stats` where a caller has them already.
    """
    ranked = global_row_number(customer_stats(raw) if stats is None else stats, _rank_order(),
                               out="ranking_receita")
    return _customer_columns(raw.clientes, ranked, vip_max, top_max)


def best_customers(raw: RawTables, stats: DataFrame, vip_max: int = VIP_MAX_RANK,
                   top_max: int = TOP_TIER_MAX_RANK) -> DataFrame:
    """The rows of :func:`customer_mart` whose segment is not the last, from a top-k: nobody else is ranked."""
    best = best_buyers(stats, max(vip_max, top_max)).select(
        "id_cliente", F.col("_rank").cast("bigint").alias("ranking_receita"))
    return _customer_columns(raw.clientes, stats.join(best, "id_cliente"), vip_max, top_max).where(
        F.col("ranking_receita").isNotNull())


def customer_mart_columns(raw: RawTables) -> DataFrame:
    """A frame with the columns of :func:`customer_mart` that is never evaluated: no job runs."""
    unranked = customer_stats(raw).withColumn("ranking_receita", F.lit(None).cast("bigint"))
    return _customer_columns(raw.clientes, unranked, VIP_MAX_RANK, TOP_TIER_MAX_RANK)


def best_buyers(stats: DataFrame, n: int) -> DataFrame:
    """``id_cliente, _rank`` of the ``n`` first buyers in rank order.

    A top-k: each task keeps ``n`` rows. Up to ``TOP_IN_ONE_TASK`` rows are numbered
    in one task and broadcast; a longer list is numbered by range and joined as it
    comes.
    """
    top = stats.orderBy(*_rank_order()).limit(n).select("id_cliente", "receita_total")
    if n <= TOP_IN_ONE_TASK:
        numbered = top.withColumn("_rank", F.row_number().over(Window.orderBy(*_rank_order())))
        return F.broadcast(numbered.select("id_cliente", "_rank"))
    return global_row_number(top, _rank_order(), out="_rank").select("id_cliente", "_rank")


def customer_segment_mart(raw: RawTables, vip_max: int = VIP_MAX_RANK,
                          top_max: int = TOP_TIER_MAX_RANK, stats: DataFrame | None = None) -> DataFrame:
    """The customer mart without ``ranking_receita``, for datasets that need
    only the segment.

    A segment depends only on whether a customer is among the best ranks up to the
    larger threshold, so the ranks are taken from a top-k (no global sort). The
    per-customer stats feed both the top-k and the join; they are written
    once to the checkpoint folder (customer-sized) so the sales are read once.
    Segments equal those of :func:`customer_mart`.
    """
    if stats is None:
        stats = materialize(customer_stats(raw), "customer-stats")
    return (
        raw.clientes.join(stats, "id_cliente", "left")
        .join(best_buyers(stats, max(vip_max, top_max)), "id_cliente", "left")
        .select(
            "id_cliente", "nome_cliente", "estado", "pais",
            F.col("data_cadastro").cast("date").alias("data_cadastro"),
            "receita_total", "total_compras", "ticket_medio",
            segment(F.col("_rank"), vip_max, top_max).alias("segmento_cliente"),
        )
    )


def top_customer_ranks(raw: RawTables, n: int, stats: DataFrame | None = None) -> DataFrame:
    """``ranking_receita, id_cliente, nome_cliente, receita_total`` of the ``n`` best-ranked
    buyers that are in the customer table, without ranking every buyer.

    The ``n`` rows are a top-k over the known buyers; a rank is one more than the
    number of buyers, known or not, that come before in rank order, counted for all
    ``n`` in one aggregate over the stats (``n`` counters, no sort). ``n`` is the
    length of a displayed list.
    """
    if stats is None:
        stats = materialize(customer_stats(raw).select("id_cliente", "receita_total"), "customer-stats")
    names = raw.clientes.select("id_cliente", "nome_cliente")
    best = stats.join(names, "id_cliente").orderBy(*_rank_order()).limit(n).collect()
    if not best:
        return stats.join(names, "id_cliente").limit(0).select(
            F.lit(0).cast("bigint").alias("ranking_receita"), "id_cliente", "nome_cliente", "receita_total")
    revenue, key = F.col("receita_total"), F.col("id_cliente")

    def before(row) -> Column:
        """Whether a buyer comes before ``row`` (NULL revenue and NULL id last)."""
        if row.receita_total is None:
            return F.coalesce(revenue.isNotNull() | (key < row.id_cliente), F.lit(False))
        return F.coalesce((revenue > row.receita_total)
                          | ((revenue == row.receita_total) & (key < row.id_cliente)), F.lit(False))

    counts = stats.agg(*[F.count_if(before(r)).alias(f"n{k}") for k, r in enumerate(best)]).first()
    rows = [(counts[k] + 1, r.id_cliente, r.nome_cliente, r.receita_total) for k, r in enumerate(best)]
    money = stats.schema["receita_total"].dataType.simpleString()
    return raw.clientes.sparkSession.createDataFrame(
        rows, f"ranking_receita bigint, id_cliente string, nome_cliente string, receita_total {money}")


# -------------------------------------------------------------- pricing mart
def latest_competitor_prices(raw: RawTables) -> DataFrame:
    """Newest observation per (product, competitor); ties broken by
    ``raw.price_tiebreak`` (or the price), all descending."""
    tiebreak = list(raw.price_tiebreak) or ["preco_concorrente"]
    order = [F.col("data_coleta").desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in tiebreak]
    latest = latest_per_group(raw.preco_competidores, ["id_produto", "nome_concorrente"], order)
    return latest.select("id_produto", "nome_concorrente", "preco_concorrente", "data_coleta")


def competitor_price_stats(raw: RawTables, keep_sums: bool = False) -> DataFrame:
    """Per product over the latest competitor prices: mean, min, max, count.

    With ``keep_sums`` the exact DECIMAL sum and count of prices behind the
    mean are kept (``_soma_precos``, ``_n_precos``) for exact comparisons.
    """
    p = F.col("preco_concorrente")
    stats = latest_competitor_prices(raw).groupBy("id_produto").agg(
        F.sum(p).cast(MONEY).alias("_soma_precos"),
        F.count(p).alias("_n_precos"),
        F.min(p).alias("preco_minimo_concorrentes"),
        F.max(p).alias("preco_maximo_concorrentes"),
        F.count(F.lit(1)).alias("qtd_concorrentes"),
    ).withColumn("preco_medio_concorrentes",
                 F.try_divide(F.col("_soma_precos").cast("double"), F.col("_n_precos")))
    cols = ["id_produto", "preco_medio_concorrentes", "preco_minimo_concorrentes",
            "preco_maximo_concorrentes", "qtd_concorrentes"]
    return stats.select(*cols, *(["_soma_precos", "_n_precos"] if keep_sums else []))


def product_sales(raw: RawTables) -> DataFrame:
    """Per product id seen in sales: units and revenue."""
    return raw.vendas.groupBy("id_produto").agg(
        F.sum("quantidade").alias("quantidade_total"),
        F.sum(_revenue()).cast(MONEY).alias("receita_total"),
    )


def pricing_mart(raw: RawTables) -> DataFrame:
    """Products having a competitor price, classified against those prices.

    All three inputs are keyed by ``id_produto``; after one exchange per side
    the two joins share that partitioning.
    """
    stats = competitor_price_stats(raw, keep_sums=True)
    produtos = raw.produtos.select("id_produto", "nome_produto", "categoria", "marca",
                                   F.col("preco_atual").alias("nosso_preco"))
    price, n, total = F.col("nosso_preco"), F.col("_n_precos"), F.col("_soma_precos")
    return (
        produtos.join(stats, "id_produto", "inner")
        .join(product_sales(raw), "id_produto", "left")
        .select(
            "id_produto", "nome_produto", "categoria", "marca", "nosso_preco",
            "preco_medio_concorrentes", "preco_minimo_concorrentes",
            "preco_maximo_concorrentes", "qtd_concorrentes",
            price_gap_pct(price, n, total).alias("diferenca_percentual_vs_media"),
            price_class(price, n, total, F.col("preco_minimo_concorrentes"),
                        F.col("preco_maximo_concorrentes")).alias("classificacao_preco"),
            F.coalesce(F.col("quantidade_total"), F.lit(0).cast("bigint")).alias("quantidade_total"),
            F.coalesce(F.col("receita_total"), F.lit(0).cast(MONEY)).alias("receita_total"),
        )
    )


# ------------------------------------------------------------------- bundle
class Marts:
    """The three marts over one set of raw tables, each built on first use.

    ``persist(...)`` keeps chosen marts in executor memory and disk after their
    first computation, for a job that builds several datasets from them (a
    dashboard page, the report). Each persisted mart is one full copy; for
    marts already loaded as tables, read the tables instead.
    """

    def __init__(self, raw: RawTables, with_daily_context: bool = False):
        self.raw = raw
        self.with_daily_context = with_daily_context
        self._persisted: list[DataFrame] = []

    def persist(self, *names: str) -> "Marts":
        """Persist the named marts (``sales``, ``customers``, ``pricing``,
        ``sales_facts`` ...) with MEMORY_AND_DISK; returns ``self``."""
        from pyspark import StorageLevel
        for name in names:
            df = getattr(self, name)
            if df not in self._persisted:
                df.persist(StorageLevel.MEMORY_AND_DISK)
                self._persisted.append(df)
        return self

    def is_persisted(self, name: str) -> bool:
        return getattr(self, name) in self._persisted

    def unpersist(self, *names: str) -> None:
        """Release the named persisted marts, or all of them without names."""
        chosen = [getattr(self, n) for n in names] if names else list(self._persisted)
        for df in chosen:
            if df in self._persisted:
                df.unpersist()
                self._persisted.remove(df)

    @cached_property
    def sales(self) -> DataFrame:
        return sales_mart(self.raw, self.with_daily_context)

    @cached_property
    def sales_facts(self) -> DataFrame:
        """Sales columns without customer or product attributes (no dimension join)."""
        return sales_enriched(self.raw, customers=False, products=False)

    @cached_property
    def sales_with_products(self) -> DataFrame:
        """Sales with product attributes only (one dimension join)."""
        return sales_enriched(self.raw, customers=False)

    @cached_property
    def customer_stats(self) -> DataFrame:
        """Per-customer stats, written once to the checkpoint folder for the frames built after them."""
        return materialize(customer_stats(self.raw), "customer-stats")

    @cached_property
    def customers(self) -> DataFrame:
        return customer_mart(self.raw, stats=vars(self).get("customer_stats"))

    @cached_property
    def best_customers(self) -> DataFrame:
        """VIP and TOP_TIER customers with their ranks (no global rank)."""
        return best_customers(self.raw, self.customer_stats)

    @cached_property
    def customer_base(self) -> DataFrame:
        """Customer attributes only (one row per customer, no sales stats)."""
        return self.raw.clientes.select(
            "id_cliente", "nome_cliente", "estado", "pais",
            F.col("data_cadastro").cast("date").alias("data_cadastro"))

    @cached_property
    def customer_segments(self) -> DataFrame:
        """Customers with segment but without the global rank (no global sort)."""
        return customer_segment_mart(self.raw, stats=self.customer_stats)

    def top_customers(self, n: int) -> DataFrame:
        """The best-ranked known buyers with their ranks (no global rank)."""
        return top_customer_ranks(self.raw, n, vars(self).get("customer_stats"))

    @cached_property
    def pricing(self) -> DataFrame:
        return pricing_mart(self.raw)


def build_marts(raw: RawTables, with_daily_context: bool = False) -> Marts:
    """The marts; the per-day context of the sales is for loading the gold table."""
    return Marts(raw, with_daily_context)
