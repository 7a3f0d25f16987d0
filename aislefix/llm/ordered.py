"""Rows dealt to tasks in ranges of a key, with ranges that both a query and its edges can name.

Spark's own range exchange chooses its bounds afresh each time and tells nobody.
Here the bounds are quantiles of the key alone, read once, so that a range
can be addressed by number: an operator that needs the row after the last one of
a range can ask for exactly that row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Error of the quantiles, as a share of one range.
_SLACK = 0.2


def range_count(df: DataFrame) -> int:
    """As many ranges as the session deals a shuffle to."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending keys, each the last of its range; what comes back is as small as that."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", shares, _SLACK / ranges)
    return sorted({int(x) for x in found})


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range a key is in, from 0; a null key is in the first."""
    if not bounds:
        return F.lit(0)
    # Two levels of comparison, so that a row meets about twice the square root of the number of bounds.
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda bound: bound < key))

    coarse = below(F.lit([g[-1] for g in groups]).cast("array<bigint>"))
    fine = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    placed = F.when(coarse < len(groups), coarse * width + below(F.get(fine, coarse))).otherwise(len(bounds))
    return F.when(key.isNull(), 0).otherwise(placed)
