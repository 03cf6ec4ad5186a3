"""All registered queries; importing a module registers its queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("job_queries", "text_queries", "search_queries", "stream_queries")

for module in MODULES:
    import_module(f"{__package__}.{module}")

__all__ = ["ORACLES", "QUERIES"]
