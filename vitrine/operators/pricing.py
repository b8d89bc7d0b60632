"""Price position of a product against its competitors' latest prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.schemas import (
    CLASS_ABOVE_AVERAGE, CLASS_AT_AVERAGE, CLASS_BELOW_AVERAGE,
    CLASS_CHEAPER_THAN_ALL, CLASS_MORE_EXPENSIVE_THAN_ALL,
)


def price_class(price: Column, n: Column, total: Column, lo: Column, hi: Column) -> Column:
    """Five-way class, tested in order. The average is ``total / n``; it is
    compared exactly as ``price * n`` against ``total`` in DECIMAL, so a price
    equal to the average is ``NA_MEDIA`` even when the quotient is not finite
    in binary."""
    scaled = price * n
    return (
        F.when(price > hi, F.lit(CLASS_MORE_EXPENSIVE_THAN_ALL))
        .when(scaled > total, F.lit(CLASS_ABOVE_AVERAGE))
        .when(price < lo, F.lit(CLASS_CHEAPER_THAN_ALL))
        .when(scaled < total, F.lit(CLASS_BELOW_AVERAGE))
        .otherwise(F.lit(CLASS_AT_AVERAGE))
    )


def price_gap_pct(price: Column, n: Column, total: Column) -> Column:
    """Percent difference to the average, 2 decimals; NULL when the average is 0."""
    diff = (price * n - total).cast("double")
    return F.round(F.try_divide(diff, total.cast("double")) * 100, 2)
