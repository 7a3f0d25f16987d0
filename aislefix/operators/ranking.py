"""The best candidate of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aislefix.functions.ids import with_prefix


def best_candidate(scored: DataFrame, *scores: Column) -> DataFrame:
    """Highest score wins; further scores break ties, then the smaller shop number."""
    order = F.struct(*(score.alias(f"s{i}") for i, score in enumerate(scores)), (-F.col("shop_no")).alias("no"))
    best = scored.groupBy("row_id").agg(F.max_by("shop_no", order).alias("shop_no"))
    return best.select("row_id", with_prefix("s", "shop_no").alias("shop_id"))
