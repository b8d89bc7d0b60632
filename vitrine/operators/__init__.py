"""Reusable relational operators the marts are assembled from."""

from vitrine.operators.daily import attach_daily_context, daily_context
from vitrine.operators.latest import latest_per_group
from vitrine.operators.pricing import price_class, price_gap_pct
from vitrine.operators.ranking import global_row_number

__all__ = [
    "attach_daily_context", "daily_context",
    "latest_per_group", "price_class", "price_gap_pct", "global_row_number",
]
