"""Per-day context of each sale: sales, distinct customers and mean revenue that day.

Spark rejects DISTINCT in window functions, and a window partitioned by day
would send a whole day to one task. One partially aggregated ``groupBy`` by day
gives all three values; it is written once, so that Spark knows its size when it
chooses the join, and joined back null-safely (a sale without a date still gets
its group's values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.materialize import materialize


def daily_context(sales: DataFrame, day: str = "data_venda", customer: str = "id_cliente",
                  revenue: str = "receita_total") -> DataFrame:
    """``day, total_vendas, total_clientes_unicos, ticket_medio`` per day."""
    return sales.groupBy(day).agg(
        F.count(F.lit(1)).alias("total_vendas"),
        F.countDistinct(customer).alias("total_clientes_unicos"),
        F.try_divide(F.sum(revenue).cast("double"), F.count(revenue)).alias("ticket_medio"),
    )


def attach_daily_context(sales: DataFrame, daily: DataFrame, day: str = "data_venda") -> DataFrame:
    """Left-join ``daily`` onto every sale by ``day`` (NULL-safe)."""
    side = materialize(daily.withColumnRenamed(day, "_day"), "daily")
    return (
        sales.join(side, sales[day].eqNullSafe(side["_day"]), "left")
        .drop("_day")
    )
