"""Display formats of the dashboard, as column expressions.

``format_number`` rounds the exact binary value half-even, like Python's
``format``; so these strings equal what the dashboard printed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brl(x: Column) -> Column:
    """Money in Brazilian format: ``R$ 1.234,56`` (swap ``,`` and ``.``)."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def brl_or_dash(x: Column) -> Column:
    """Like :func:`brl`, with an em dash for NULL."""
    return F.coalesce(brl(x), F.lit("—"))


def signed_percent(x: Column, decimals: int = 1) -> Column:
    """Signed percent with a fixed number of decimals: ``+1.2%`` / ``-0.4%``."""
    pattern = "0." + "0" * decimals if decimals > 0 else "0"
    text = decimal_pattern(x, pattern)
    sign = F.when(text.startswith("-"), F.lit("")).otherwise(F.lit("+"))
    return F.concat(sign, text, F.lit("%"))


def decimal_pattern(x: Column, pattern: str) -> Column:
    """``format_number`` with a DecimalFormat pattern such as ``0.0`` (no grouping)."""
    return F.call_function("format_number", x, F.lit(pattern))


def thousands(n: Column) -> Column:
    """Integer with comma thousands separators: ``12,345``."""
    return F.format_number(n, 0)
