"""Candidate shops for each row, through an index from access point to shops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aislefix.functions.ids import id_number
from aislefix.functions.scans import hits_of
from aislefix.operators.spread import spread_join


def ap_signal_pairs(hits: DataFrame) -> DataFrame:
    """Distinct (access point, shop, signal) with the number of hits behind each.

    Signals are small integers, so this is far smaller than the hits, and hot
    access points shrink before the shuffle.
    """
    return hits.groupBy("wifi_bssid", "shop_no", "wifi_signal").agg(F.count("*").alias("n"))


def _strongest_shops(pairs: DataFrame, width: int) -> DataFrame:
    """Shops of the ``width`` strongest (shop, signal) pairs of each access point.

    A shop may fill several of the places. The rank filter is also applied
    before the shuffle, so no access point brings more than ``width`` rows per task.
    """
    best_first = Window.partitionBy("wifi_bssid").orderBy(F.desc("wifi_signal"), "shop_no")
    ranked = pairs.select("wifi_bssid", "shop_no", "wifi_signal", F.row_number().over(best_first).alias("_rank"))
    return ranked.where(F.col("_rank") <= width).select("wifi_bssid", "shop_no").distinct()


def ap_index_train(
    pairs: DataFrame, width: int = 12, min_support: int = 6, counts: DataFrame | None = None
) -> DataFrame:
    """Index for the labelled rows: access points with enough hits, strongest pairs only.

    ``counts`` has the hits of each (access point, shop); without it they come from ``pairs``.
    """
    counted = pairs if counts is None else counts
    supported = (
        counted.groupBy("wifi_bssid").agg(F.sum("n").alias("_support")).where(F.col("_support") >= min_support)
    )
    return _strongest_shops(pairs, width).join(supported.select("wifi_bssid"), "wifi_bssid")


def ap_popular_shops(pairs: DataFrame, width: int = 3) -> DataFrame:
    """The shops with most hits of each access point; equal counts go to the smaller shop number."""
    counts = pairs.groupBy("wifi_bssid", "shop_no").agg(F.sum("n").alias("n"))
    most_first = Window.partitionBy("wifi_bssid").orderBy(F.desc("n"), "shop_no")
    ranked = counts.withColumn("_rank", F.row_number().over(most_first))
    return ranked.where(F.col("_rank") <= width).select("wifi_bssid", "shop_no", "n")


def ap_index_query(
    pairs: DataFrame, width: int = 15, popular_width: int = 3, counts: DataFrame | None = None
) -> DataFrame:
    """Index for the query rows: strongest pairs of all access points, and the most frequent shops."""
    strongest = _strongest_shops(pairs, width)
    popular = ap_popular_shops(pairs if counts is None else counts, popular_width).select("wifi_bssid", "shop_no")
    return strongest.unionByName(popular).distinct()


def _probe(rows: DataFrame, index: DataFrame, *carry: str) -> DataFrame:
    """Rows joined to the index by each distinct access point of their scan; repeats possible."""
    seen = rows.select(
        "row_id", *carry, F.explode(F.array_distinct(hits_of(rows)["wifi_bssid"])).alias("wifi_bssid")
    )
    return spread_join(seen, index, "wifi_bssid").drop("wifi_bssid")


def _one_per_pair(pairs: DataFrame) -> DataFrame:
    """One row per (row, shop), placed by row for the joins and the ranking that follow."""
    placed = pairs.repartition("row_id")
    if "label" in pairs.columns:
        return placed.groupBy("row_id", "shop_no").agg(F.max("label").alias("label"))
    return placed.distinct()


def _index_pairs_train(label_rows: DataFrame, index: DataFrame) -> DataFrame:
    rows = label_rows.withColumn("true_no", id_number("shop_id"))
    found = _probe(rows, index, "true_no")
    return found.select("row_id", "shop_no", (F.col("shop_no") == F.col("true_no")).cast("int").alias("label"))


def _true_pairs(label_rows: DataFrame) -> DataFrame:
    return label_rows.select("row_id", id_number("shop_id").alias("shop_no"), F.lit(1).alias("label"))


def prior_top1(prior: DataFrame) -> DataFrame:
    """The first guess of the earlier model for each row; rows without one are absent."""
    first = prior.where((F.col("shop_index") == 0) & F.col("shop_id").isNotNull())
    names = ["row_id", id_number("shop_id").alias("shop_no")]
    return first.select(*names, "label") if "label" in prior.columns else first.select(*names)


def index_pairs_train(label_rows: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs found by the index alone, labelled 1 where the shop is the visited one."""
    return _one_per_pair(_index_pairs_train(label_rows, index))


def candidate_pairs_train(label_rows: DataFrame, index: DataFrame) -> DataFrame:
    """Index pairs and, for every label row, its true pair."""
    return _one_per_pair(_index_pairs_train(label_rows, index).unionByName(_true_pairs(label_rows)))


def candidate_union_train(label_rows: DataFrame, index: DataFrame, prior: DataFrame) -> DataFrame:
    """Index pairs, true pairs and the earlier model's guesses."""
    guesses = prior_top1(prior).join(label_rows.select("row_id"), "row_id", "left_semi")
    pairs = _index_pairs_train(label_rows, index).unionByName(_true_pairs(label_rows))
    return _one_per_pair(pairs.unionByName(guesses))


def candidate_pairs_query(query_rows: DataFrame, index: DataFrame) -> DataFrame:
    return _one_per_pair(_probe(query_rows, index))


def candidate_union_query(query_rows: DataFrame, index: DataFrame, prior: DataFrame) -> DataFrame:
    guesses = prior_top1(prior).join(query_rows.select("row_id"), "row_id", "left_semi")
    return _one_per_pair(_probe(query_rows, index).unionByName(guesses))


def candidate_recall(label_rows: DataFrame, index: DataFrame) -> DataFrame:
    """How many label rows find their true shop by the index alone."""
    none, one = F.lit(0), F.lit(1)
    rows = label_rows.select(one.alias("label_rows"), none.alias("index_pairs"), none.alias("true_pairs"))
    found = index_pairs_train(label_rows, index).select(
        none.alias("label_rows"), one.alias("index_pairs"), F.col("label").alias("true_pairs")
    )
    totals = rows.unionByName(found).agg(*(F.sum(name).alias(name) for name in rows.columns))
    return totals.withColumn("recall", F.try_divide("true_pairs", "label_rows"))
