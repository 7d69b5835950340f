"""Era-aware box-office analytics as Spark DataFrame jobs."""

from eraframe.plans.catalog import REPORTS, describe_reports, run_report
from eraframe.sources.star import Star, read_star, write_star

__all__ = [
    "REPORTS",
    "Star",
    "describe_reports",
    "read_star",
    "run_report",
    "write_star",
]
