"""The registered queries and their independent SQL counterparts."""

from __future__ import annotations


def all_queries():
    from importlib import import_module

    from parvis.catalog.registry import REGISTRY

    for module in ("sales", "feature", "error", "gem", "place", "page", "model", "source", "request"):
        import_module(f"parvis.catalog.{module}_queries")
    return dict(REGISTRY)
