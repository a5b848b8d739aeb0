"""Registered queries and the SQL that checks them, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("quality", "stores", "documents", "graph", "retrieval", "answers", "streams")


def all_queries() -> dict:
    """Every registered query: name -> (function of session and folder, SQL or None)."""
    merged: dict = {}
    for area in AREAS:
        for name, pair in import_module(f"registry.{area}").QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = pair
    return merged
