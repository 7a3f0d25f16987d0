"""Equi-joins that stay splittable when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_BUCKET = "_spread_bucket"


def spread_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of a large ``left`` that may have hot keys with a ``right`` that is narrow per key.

    Adaptive execution splits a hot partition only where both inputs come
    straight out of a shuffle made for the join. A ``right`` that was just
    grouped or ranked by the join key needs no such shuffle, and then one task
    would get every row of a hot key. The extra hash column makes the present
    partitioning unfit, so both sides are shuffled for the join: hot partitions
    are split, and a small ``right`` is still broadcast after its size is known.
    Six bits of hash are enough for that; all 64 would be eight bytes a shuffled row that do not compress.
    """
    keys = [on] if isinstance(on, str) else list(on)
    for key in keys:
        types = left.schema[key].dataType, right.schema[key].dataType
        if types[0] != types[1]:
            raise TypeError(f"join key {key} differs in type: {types[0]} and {types[1]}")
    bucket = F.shiftrightunsigned(F.xxhash64(*keys), 58)
    joined = left.withColumn(_BUCKET, bucket).join(right.withColumn(_BUCKET, bucket), [*keys, _BUCKET], how)
    return joined.drop(_BUCKET)
