"""Queries over the driver's tables, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .plans import grid_queries, location_queries, modal_queries, mode_queries, more_queries, preparation_queries, series_queries, signal_queries, vector_queries  # noqa: F401  each adds its queries

QUERIES: dict = signal_queries.QUERIES
ORACLES: dict[str, str] = signal_queries.ORACLES
