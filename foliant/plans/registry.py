"""All queries over the driver's tables with their SQL, collected from the modules of this package."""

from __future__ import annotations

from . import book_plans, knowledge_plans, model_plans, report_plans, search_plans, source_plans, stream_plans, text_plans  # noqa: F401
from .base import QUERIES, SQL
from .search_plans import flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
