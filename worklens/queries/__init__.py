"""Queries by name; importing the modules fills the registry."""

from worklens.queries import (  # noqa: F401
    board_items,
    change_events,
    file_queries,
    match_queries,
    plan_queries,
    report_queries,
    scalars,
    search_queries,
    source_queries,
    texts,
)
from worklens.queries.base import REGISTRY

__all__ = ["REGISTRY"]
