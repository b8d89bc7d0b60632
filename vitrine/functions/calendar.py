"""Calendar labels as map lookups (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.schemas import MONTH_LABELS, WEEKDAY_DISPLAY_ORDER, WEEKDAY_NAMES


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def weekday_name(ts: Column) -> Column:
    """Portuguese weekday name; Spark's dayofweek is 1 = Sunday ... 7 = Saturday."""
    return F.try_element_at(_literal_map(WEEKDAY_NAMES.items()), F.dayofweek(ts))


def weekday_order(name: Column) -> Column:
    """Display position of a weekday name, Monday = 1; unknown names give NULL."""
    return F.try_element_at(
        _literal_map((n, i + 1) for i, n in enumerate(WEEKDAY_DISPLAY_ORDER)), name)


def month_label(month: Column) -> Column:
    """Short Portuguese month label for month numbers 1..12, else NULL."""
    return F.try_element_at(_literal_map((i + 1, m) for i, m in enumerate(MONTH_LABELS)), month)
