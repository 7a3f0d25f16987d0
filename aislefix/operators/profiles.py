"""What visits of a time window tell about shops and their access points.

Everything follows from one aggregate of the hits by (shop, access point): the
shop level is a second, much smaller aggregate over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aislefix.operators.spread import spread_join


def ap_stats(hits: DataFrame, min_support: int = 1, cutoff_day: int | None = None) -> DataFrame:
    """Counts and signal sums per (shop, access point), over all hits and over strongest hits.

    With ``cutoff_day`` the same pass also sums the hits up to that day, so two
    windows cost one shuffle. Access points under ``min_support`` hits stay in
    for the strongest-hit columns, but their ``n_hits`` is 0.
    """
    first = F.col("k") == 1
    sums = {
        "n_hits": F.count("*"),
        "signal_sum": F.sum("wifi_signal"),
        "n_first": F.count_if(first),
        "first_signal_sum": F.sum(F.when(first, F.col("wifi_signal"))),
    }
    if cutoff_day is not None:
        early = F.col("transaction_day") <= cutoff_day
        sums["feature_hits"] = F.count_if(early)
        sums["feature_signal_sum"] = F.sum(F.when(early, F.col("wifi_signal")))
    stats = hits.groupBy("shop_no", "wifi_bssid").agg(*(value.alias(name) for name, value in sums.items()))
    return with_support(stats, min_support)


def with_support(stats: DataFrame, min_support: int) -> DataFrame:
    """Access points of too few hits lose their counts, but for those of strongest hits."""
    if min_support <= 1:
        return stats
    support = stats.groupBy("wifi_bssid").agg(F.sum("n_hits").alias("_support"))
    enough = F.col("_support") >= min_support
    return (
        spread_join(stats, support, "wifi_bssid")
        .withColumn("n_hits", F.when(enough, F.col("n_hits")).otherwise(0))
        .withColumn("signal_sum", F.when(enough, F.col("signal_sum")))
        .drop("_support")
    )


def _mean(total: Column | str, count: Column | str) -> Column:
    """Floating-point quotient; null where nothing was counted."""
    return F.try_divide(total, count)


def ap_profile(stats: DataFrame, window_days: int) -> DataFrame:
    """Mean signal and hits per day of each access point at each shop."""
    return stats.where("n_hits > 0").select(
        "shop_no",
        "wifi_bssid",
        _mean("signal_sum", "n_hits").alias("wifi_signal"),
        (F.col("n_hits") / F.lit(window_days)).alias("sw_number"),
    )


def shop_mean_signal(stats: DataFrame) -> DataFrame:
    return stats.where("n_hits > 0").groupBy("shop_no").agg(
        (F.sum("signal_sum") / F.sum("n_hits")).alias("shop_wifi_signal")
    )


def _mode(count: str, signal_sum: str) -> Column:
    """The most frequent access point of a group; then the stronger, then the smaller id."""
    mean = _mean(signal_sum, count)
    candidate = F.struct(F.col(count).alias("n"), mean.alias("mean"), (-F.col("wifi_bssid")).alias("negated"))
    return F.max(F.when(F.col(count) > 0, candidate))


def shop_modal_ap(stats: DataFrame) -> DataFrame:
    modes = stats.groupBy("shop_no").agg(_mode("n_hits", "signal_sum").alias("m")).where("m is not null")
    return modes.select(
        "shop_no",
        (-F.col("m.negated")).alias("swifi_bssid_maxsignal"),
        F.col("m.mean").alias("swifi_signal_maxsignal"),
    )


def shop_modal_ap_ties(stats: DataFrame) -> DataFrame:
    """Every access point that shares the highest hit count of its shop."""
    seen = stats.where("n_hits > 0").select("shop_no", "wifi_bssid", "n_hits")
    highest = seen.groupBy("shop_no").agg(F.max("n_hits").alias("_highest"))
    return spread_join(seen, highest, "shop_no").where("n_hits = _highest").drop("_highest")


def shop_slot1_mean(stats: DataFrame) -> DataFrame:
    return stats.where("n_first > 0").groupBy("shop_no").agg(
        (F.sum("first_signal_sum") / F.sum("n_first")).alias("swifi1_signal_all")
    )


def shop_slot1_variety(stats: DataFrame, window_days: int) -> DataFrame:
    """Distinct strongest access points per day."""
    return stats.where("n_first > 0").groupBy("shop_no").agg(
        (F.count("*") / F.lit(window_days)).alias("shop_wifi_num")
    )


def shop_slot1_modal_ap(stats: DataFrame) -> DataFrame:
    modes = stats.groupBy("shop_no").agg(_mode("n_first", "first_signal_sum").alias("m")).where("m is not null")
    return modes.select(
        "shop_no",
        (-F.col("m.negated")).alias("swifi1_bssid_maxsignal"),
        F.col("m.mean").alias("swifi1_signal_maxsignal"),
    )


def shop_ap_list(stats: DataFrame) -> DataFrame:
    """The distinct access points of each shop, one row each."""
    return stats.where("n_hits > 0").select("shop_no", "wifi_bssid")


def shop_profile(stats: DataFrame, window_days: int) -> DataFrame:
    """The seven columns of the shop profile in one aggregate over ``stats``.

    Shops without a supported hit have no profile. A shop's access points are in
    ``shop_ap_list``; no feature needs them in one cell.
    """
    grouped = stats.groupBy("shop_no").agg(
        _mode("n_hits", "signal_sum").alias("m"),
        _mode("n_first", "first_signal_sum").alias("m1"),
        _mean(F.sum("signal_sum"), F.sum("n_hits")).alias("shop_wifi_signal"),
        _mean(F.sum("first_signal_sum"), F.sum("n_first")).alias("swifi1_signal_all"),
        (F.count_if(F.col("n_first") > 0) / F.lit(window_days)).alias("shop_wifi_num"),
    )
    return grouped.where("m is not null").select(
        "shop_no",
        (-F.col("m.negated")).alias("swifi_bssid_maxsignal"),
        F.col("m.mean").alias("swifi_signal_maxsignal"),
        "shop_wifi_signal",
        "swifi1_signal_all",
        "shop_wifi_num",
        (-F.col("m1.negated")).alias("swifi1_bssid_maxsignal"),
        F.col("m1.mean").alias("swifi1_signal_maxsignal"),
    )
