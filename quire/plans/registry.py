"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "source_queries", "extract_queries", "text_queries", "state_queries", "layout_queries", "stream_queries",
)


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"quire.plans.{name}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
