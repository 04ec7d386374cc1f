"""Imports every query module, which registers its queries."""

from tickerloom.catalog import feature_queries, panel_queries, record_queries, study_queries  # noqa: F401
from tickerloom.catalog.registry import QUERIES

__all__ = ["QUERIES"]
