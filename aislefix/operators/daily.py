"""What one day's hits tell, kept so that days can be merged: a window is a merge, a new day an append.

Two tables, each in partitions by day:

- ``sums``: hits and signal sums per (shop, access point), over all hits and over strongest hits. Sums add up, so profiles,
  support and the most frequent shops of any window follow from them.
- ``best``: per access point the ``width`` strongest distinct (shop, signal) pairs. A pair that is among the first of a window
  is among the first of every day it occurs on, as a day has no more pairs to beat it than the window; so the first of
  the merged days are the first of the window, ties included, for any width up to the stored one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aislefix.operators.hits import visit_hits
from aislefix.operators.profiles import with_support

DAY = "transaction_day"
SUMS = "shop_no bigint, wifi_bssid bigint, n_hits bigint, signal_sum bigint, n_first bigint, first_signal_sum bigint"
BEST = "wifi_bssid bigint, shop_no bigint, wifi_signal int"


def daily_sums(hits: DataFrame) -> DataFrame:
    first = F.col("k") == 1
    return hits.groupBy("shop_no", "wifi_bssid", DAY).agg(
        F.count("*").alias("n_hits"),
        F.sum("wifi_signal").alias("signal_sum"),
        F.count_if(first).alias("n_first"),
        F.sum(F.when(first, F.col("wifi_signal"))).alias("first_signal_sum"),
    )


def daily_best(hits: DataFrame, width: int) -> DataFrame:
    pairs = hits.select("wifi_bssid", "shop_no", "wifi_signal", DAY).distinct()
    best_first = Window.partitionBy("wifi_bssid", DAY).orderBy(F.desc("wifi_signal"), "shop_no")
    ranked = pairs.withColumn("_rank", F.row_number().over(best_first))
    return ranked.where(F.col("_rank") <= width).drop("_rank")


def merged_stats(sums: DataFrame, min_support: int = 1, cutoff_day: int | None = None) -> DataFrame:
    """The days of ``sums`` as one window, in the form of ``profiles.ap_stats``."""
    totals = {name: F.sum(name) for name in ("n_hits", "signal_sum", "n_first", "first_signal_sum")}
    if cutoff_day is not None:
        early = F.col(DAY) <= cutoff_day
        totals["feature_hits"] = F.coalesce(F.sum(F.when(early, F.col("n_hits"))), F.lit(0).cast("bigint"))
        totals["feature_signal_sum"] = F.sum(F.when(early, F.col("signal_sum")))
    stats = sums.groupBy("shop_no", "wifi_bssid").agg(*(total.alias(name) for name, total in totals.items()))
    return with_support(stats, min_support)


def merged_pairs(best: DataFrame) -> DataFrame:
    """The days of ``best`` as one table of distinct pairs."""
    return best.select("wifi_bssid", "shop_no", "wifi_signal").distinct()


def merged_counts(sums: DataFrame) -> DataFrame:
    """Hits per (access point, shop); rows repeat where days do, and add up."""
    return sums.select("wifi_bssid", "shop_no", F.col("n_hits").alias("n"))


@dataclass(frozen=True)
class DayState:
    """Both tables in a folder, for any number of days."""

    spark: SparkSession
    path: str
    width: int = 15

    def add(self, visits: DataFrame, days: Sequence[int] | None = None) -> DayState:
        """Write the state of these visits' days; a day that is there already is replaced.

        With ``days`` only these are read, where visits are stored by day.
        """
        if days is not None:
            column = F.col(DAY) if DAY in visits.columns else F.dayofmonth("time_stamp")
            visits = visits.where(column.isin(list(days)))
        found = visit_hits(visits)
        for name, table in (("sums", daily_sums(found)), ("best", daily_best(found, self.width))):
            writer = table.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(DAY).parquet(f"{self.path}/{name}")
        return self

    def sums(self, until: int | None = None) -> DataFrame:
        return self._read("sums", SUMS, until)

    def best(self, width: int, until: int | None = None) -> DataFrame:
        if width > self.width:
            raise ValueError(f"the state keeps {self.width} pairs a day; {width} were asked for")
        return self._read("best", BEST, until)

    def _read(self, name: str, schema: str, until: int | None) -> DataFrame:
        table = self.spark.read.schema(f"{schema}, {DAY} int").parquet(f"{self.path}/{name}")
        return table if until is None else table.where(F.col(DAY) <= until)
