"""Bindings of the operators to the test tables, with the SQL to check them."""

from importlib import import_module

_MODULES = (
    "mapmetrics", "neighbourhood", "gates", "catalog", "cells", "summaries", "inference", "allocation",
    "embeddings", "parcels", "selection", "evaluate",
)


def load_queries():
    """Import every binding module and return (queries, check statements)."""
    for name in _MODULES:
        import_module(f"{__name__}.q_{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
