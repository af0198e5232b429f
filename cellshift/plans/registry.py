"""Query table: key -> Spark callable, and key -> check SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(*parts: str) -> str:
    """Compose one statement: named CTEs, ad-hoc CTE texts, then the final SELECT."""
    *withs, final = parts
    texts, seen = [], set()

    def add(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        needs, body = CTES[name]
        for n in needs:
            add(n)
        texts.append(f"{name} AS ({body})")

    for w in withs:
        add(w) if w in CTES else texts.append(w.strip().rstrip(","))
    head = "WITH RECURSIVE " + ",\n".join(texts) + "\n" if texts else ""
    return head + final


def query(key: str, oracle: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register
