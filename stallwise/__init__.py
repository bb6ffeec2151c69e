"""Spark-native data-quality audits and commerce reports for marketplace tables."""

from stallwise.marketplace import Marketplace
from stallwise.plans.catalog import REPORTS, run_report

__all__ = ["Marketplace", "REPORTS", "run_report"]
