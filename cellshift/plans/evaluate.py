"""Whole-run composition: quality control, predictions of several methods, metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import mapmetrics as M
from ..operators.cells import pair_profile, qc_status


def evaluate_methods(
    cells: DataFrame, keys: Sequence[str], methods: dict[str, str], has_embedding: Column
) -> tuple[DataFrame, DataFrame]:
    """Metric rows of every method on the included keys, and failure rows for the others.

    ``cells`` may have NULL classes where a grid lacks a cell; ``methods`` maps a
    method name to its prediction column.
    """
    qc = qc_status(pair_profile(cells, keys), has_embedding)
    cont = M.method_contingency(cells, keys, methods)
    ok = qc.filter("qc_status = 'include'").select(*keys)
    rows = M.metric_row(cont.join(ok, list(keys), "left_semi"), ["method", *keys])
    failures = qc.filter("qc_status <> 'include'").select(*keys, "qc_status", "excluded_reason")
    return rows, failures


def failure_records(failures: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One failure row per method and excluded key."""
    return failures.select(
        *keys, F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"),
        F.col("excluded_reason").alias("error"),
    )
