"""One row per access point seen in a scan, and counts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aislefix.functions.ids import id_number
from aislefix.functions.scans import hits_of
from aislefix.operators.spread import spread_join


def in_feature_window(visits: DataFrame, cutoff_day: int) -> Column:
    """By the column ``transaction_day`` where there is one, as stored visits are partitioned by it."""
    stored = "transaction_day" in visits.columns
    return (F.col("transaction_day") if stored else F.dayofmonth("time_stamp")) <= cutoff_day


def explode_hits(rows: DataFrame, carry: Sequence[Column | str]) -> DataFrame:
    """Scan rows -> (carried columns, k, pos, wifi_bssid, wifi_signal, wifi_flag); k = 1 is the strongest."""
    ranked = rows.select(*carry, hits_of(rows).alias("_ranked"))
    names = [name for name in ranked.columns if name != "_ranked"]
    return ranked.select(*names, F.posexplode("_ranked").alias("_place", "_hit")).select(
        *names,
        (F.col("_place") + 1).alias("k"),
        F.col("_hit.pos").alias("pos"),
        F.col("_hit.wifi_bssid").alias("wifi_bssid"),
        (-F.col("_hit.weakness")).alias("wifi_signal"),
        F.col("_hit.wifi_flag").alias("wifi_flag"),
    )


def visit_hits(visits: DataFrame) -> DataFrame:
    """Hits of visits with the visited shop as a number; visits without a shop tell nothing about shops."""
    visits = visits.where(F.col("shop_id").isNotNull())
    carry = ["row_id", id_number("shop_id").alias("shop_no"), F.dayofmonth("time_stamp").alias("transaction_day")]
    return explode_hits(visits, carry)


def ap_hit_count(hits: DataFrame) -> DataFrame:
    return hits.groupBy("wifi_bssid").agg(F.count("*").alias("wifi_counts"))


def with_min_support(hits: DataFrame, min_support: int) -> DataFrame:
    """Hits whose access point has at least ``min_support`` hits, with that count."""
    supported = ap_hit_count(hits).where(F.col("wifi_counts") >= min_support)
    return spread_join(hits, supported, "wifi_bssid")
