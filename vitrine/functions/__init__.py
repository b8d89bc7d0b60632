"""Column functions built from Spark built-ins (no Python UDFs)."""

from vitrine.functions.calendar import month_label, weekday_name, weekday_order
from vitrine.functions.formatting import brl, brl_or_dash, signed_percent, thousands
from vitrine.functions.text import text_chunks

__all__ = [
    "month_label", "weekday_name", "weekday_order",
    "brl", "brl_or_dash", "signed_percent", "thousands", "text_chunks",
]
