"""Query plans: marts, report sections, dashboard datasets, read-only SQL."""

from vitrine.plans.marts import Marts, build_marts

__all__ = ["Marts", "build_marts"]
