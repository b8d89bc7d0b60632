"""vitrine: retail analytics marts, reports and dashboard datasets on Spark.

Raw sales, customers, products and competitor price observations become three
typed marts (sales over time, customer segmentation, price competitiveness).
Reports, dashboard datasets, loading with type and key contracts, and read-only
SQL sit on top. Everything is DataFrame / Spark SQL with built-in functions.
"""

from vitrine.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
