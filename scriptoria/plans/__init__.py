"""Operators bound to the driver's tables, with their check queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _module in (
    "text_queries",
    "style_queries",
    "ailike_queries",
    "similarity_queries",
    "authorship_queries",
    "record_queries",
    "event_queries",
    "stream_queries",
    "ml_queries",
):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
