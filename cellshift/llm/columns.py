"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Space and \x09-\x0D, as the argument of a translate and as a pattern.
SEPARATORS = " \t\n\x0b\x0c\r"
SPLIT = "[ \\t-\\r]+"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case: what an operator adds replaces what was there."""
    gone = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in gone))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
