"""Executive report: four fixed sections over the marts.

Each section is a small DataFrame (at most a week of days, one row per segment
or price class, or a top-k). ``run_report`` evaluates each one on its own so a
failing section becomes a one-row ``erro`` frame and the others still run;
``write_report`` stores the sections under a dated partition, and the errors in a
dataset of their own. Marts and a ``MartSource`` serve alike: the sections read the
leanest form of each mart.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.materialize import materialize
from vitrine.plans.marts import Marts, mean
from vitrine.schemas import (
    CLASS_MORE_EXPENSIVE_THAN_ALL, MONEY, REPORT_CRITICAL_PRODUCTS, REPORT_LAST_DAYS,
)

ERRORS = "erros"         # dataset of failed sections
AVERAGE_DIGITS = 6       # averages of per-row averages are rounded to this many decimals


def exact_mean_2dp(col: str) -> F.Column:
    """Mean of a 2-decimal column, summed exactly in DECIMAL then divided."""
    return mean(F.col(col).cast(MONEY))


def sales_last_days(sales: DataFrame, days: int = REPORT_LAST_DAYS) -> DataFrame:
    """Revenue, distinct sales, distinct customers and mean ticket for the last
    ``days`` dates that have sales (not calendar days), newest first.

    The dates are chosen first: a top-k over the distinct dates (Catalyst drops
    the dimension joins from that branch, so it reads one column of the sales),
    at most ``days`` values reach the driver. They become a literal predicate
    that is pushed below the dimension joins to the sales rows, so only those
    days are joined and aggregated with the two distinct counts.
    """
    chosen = [r[0] for r in sales.select("data_venda").distinct()
              .orderBy(F.col("data_venda").desc_nulls_last()).limit(days).collect()]
    known = [d for d in chosen if d is not None]
    day = F.col("data_venda")
    keep = day.isin(known) if known else F.lit(False)
    if known and not len(known) < len(chosen) and {"ano_venda", "mes_venda"} <= set(sales.columns):
        # the same days stated on the loaded table's partition columns: prunes its partitions
        keep = (keep & F.col("ano_venda").isin(sorted({d.year for d in known}))
                & F.col("mes_venda").isin(sorted({d.month for d in known})))
    if len(known) < len(chosen):
        keep = keep | day.isNull()
    rev = F.col("preco_unitario") * F.col("quantidade")
    return (
        sales.where(keep).groupBy("data_venda", "dia_semana_nome").agg(
            F.sum("receita_total").cast(MONEY).alias("receita"),
            F.countDistinct("id_venda").alias("vendas"),
            F.countDistinct("id_cliente").alias("clientes"),
            mean(rev.cast(MONEY)).alias("ticket_medio"),
        )
        .orderBy(F.col("data_venda").desc_nulls_last())
        .limit(days)
    )


def segments_summary(customers: DataFrame) -> DataFrame:
    """Per segment: customers, revenue, mean ticket, mean purchases; by revenue."""
    return (
        customers.groupBy("segmento_cliente").agg(
            F.count(F.lit(1)).alias("total_clientes"),
            F.sum("receita_total").cast(MONEY).alias("receita_total"),
            F.round(F.avg("ticket_medio"), AVERAGE_DIGITS).alias("ticket_medio_avg"),
            mean("total_compras").alias("compras_avg"),
        )
        .orderBy(F.col("receita_total").desc_nulls_last(), F.col("segmento_cliente").asc_nulls_last())
    )


def price_classes_summary(pricing: DataFrame) -> DataFrame:
    """Per price class: products, mean gap, revenue; by product count."""
    return (
        pricing.groupBy("classificacao_preco").agg(
            F.count(F.lit(1)).alias("total_produtos"),
            exact_mean_2dp("diferenca_percentual_vs_media").alias("dif_media_pct"),
            F.sum("receita_total").cast(MONEY).alias("receita_impactada"),
        )
        .orderBy(F.col("total_produtos").desc(), F.col("classificacao_preco").asc_nulls_last())
    )


def critical_products(pricing: DataFrame, klass: str = CLASS_MORE_EXPENSIVE_THAN_ALL,
                      n: int = REPORT_CRITICAL_PRODUCTS) -> DataFrame:
    """The ``n`` products of class ``klass`` with the largest gap (ties: id)."""
    return (
        pricing.where(F.col("classificacao_preco") == klass)
        .orderBy(F.col("diferenca_percentual_vs_media").desc_nulls_last(),
                 F.col("id_produto").asc_nulls_last())
        .limit(n)
        .select("nome_produto", "categoria", "nosso_preco", "preco_medio_concorrentes",
                "diferenca_percentual_vs_media", "receita_total")
    )


SECTIONS: dict[str, Callable[[Marts], DataFrame]] = {
    "vendas": lambda m: sales_last_days(m.sales_facts),
    "clientes": lambda m: segments_summary(m.customer_segments),
    "pricing": lambda m: price_classes_summary(m.pricing),
    "criticos": lambda m: critical_products(m.pricing),
}


def error_frame(spark: SparkSession, exc: BaseException) -> DataFrame:
    return spark.createDataFrame([(str(exc),)], "erro string")


def run_report(spark: SparkSession, marts: Marts,
               sections: dict[str, Callable[[Marts], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Evaluate each section in isolation.

    Spark reports most errors only when an action runs, so each section is
    planned and executed inside its own ``try``. The section results are
    bounded (see the section functions), so they are collected and handed back
    as small frames; a failure yields ``DataFrame(erro=[message])``. Sections that a
    caller gives are written to the checkpoint folder instead, since nothing bounds
    them. The pricing mart feeds two sections, so it is persisted for the run when
    the default sections are used. ``marts`` is a ``Marts`` or a ``MartSource``.

    The sections rely on unique customer and product keys: marts built here are refused as a whole
    (``ContractViolation``) if an input key is NULL or repeated. Loaded marts passed that gate.
    """
    from vitrine.sources.tables import require_unique_inputs

    built_here = getattr(marts, "marts", None) or marts
    if hasattr(built_here, "raw"):
        require_unique_inputs(built_here.raw)
    out = {}
    shared = False
    if sections is None:
        try:
            shared = not marts.is_persisted("pricing")
            if shared:
                marts.persist("pricing")
        except Exception:  # noqa: BLE001 - a failing mart is reported by its sections
            shared = False
    try:
        for name, build in (sections or SECTIONS).items():
            try:
                df = build(marts)
                out[name] = (spark.createDataFrame(df.collect(), df.schema) if sections is None
                             else materialize(df, f"report-{name}"))
            except Exception as exc:  # noqa: BLE001 - isolation is the point
                out[name] = error_frame(spark, exc)
    finally:
        if shared:
            marts.unpersist("pricing")
    return out


def write_report(sections: dict[str, DataFrame], base_path: str,
                 day: _dt.date | None = None) -> dict[str, str]:
    """Write each section to ``{base_path}/{section}/data_relatorio=YYYY-MM-DD``.

    Dynamic partition overwrite replaces only that day's partition, so a rerun
    on the same day is idempotent and earlier days are kept. A section that failed
    has other columns; its text goes to ``{base_path}/erros``, partitioned by day
    and section.
    """
    day = (day or _dt.date.today()).isoformat()
    paths = {}
    for name, df in sections.items():
        failed = df.columns == ["erro"]
        path = f"{base_path}/{ERRORS if failed else name}"
        dated = df.withColumn("data_relatorio", F.lit(day))
        keys = ["data_relatorio"]
        if failed:
            dated, keys = dated.withColumn("secao", F.lit(name)), ["data_relatorio", "secao"]
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(path))
        paths[name] = path
    return paths
