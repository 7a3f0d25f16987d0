"""Ids are text with a one-letter prefix (``s_12``); inside jobs they travel as bigint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def id_number(column: Column | str) -> Column:
    """``s_12`` -> 12, ``b_-999`` -> -999."""
    return F.substring_index(column, "_", -1).cast("bigint")


def with_prefix(prefix: str, column: Column | str) -> Column:
    """12 -> ``s_12``; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix + "_"), column.cast("string"))
