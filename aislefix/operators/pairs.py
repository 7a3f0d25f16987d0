"""Features of (row, candidate shop) pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from aislefix.functions.scans import hits_of
from aislefix.operators.known import KnownKeys
from aislefix.operators.profiles import ap_profile
from aislefix.operators.spread import spread_join
from aislefix.settings import SLOTS


def pair_geo(pairs: DataFrame) -> DataFrame:
    """Planar differences between row and shop, and their squared sum."""
    east = F.col("longitude") - F.col("slongitude")
    north = F.col("latitude") - F.col("slatitude")
    return pairs.withColumns(
        {"longitude_cha": east, "latitude_cha": north, "dist": east * east + north * north}
    )


def pair_signal(pairs: DataFrame) -> DataFrame:
    """Strongest hit of the row against the shop's modal access point."""
    return pairs.withColumns(
        {
            "wifi_bssid_maxsignal_cha": F.col("wifi1_bssid") - F.col("swifi_bssid_maxsignal"),
            "wifi_signal_maxsignal_cha": F.col("wifi1_signal") - F.col("swifi_signal_maxsignal"),
        }
    )


def lookup_train(stats: DataFrame, window_days: int) -> DataFrame:
    """What a (shop, access point) tells about a labelled row: one window serves slots and overlap."""
    return ap_profile(stats, window_days)


def lookup_query(stats: DataFrame, feature_days: int, answer_days: int, slot_window: str = "feature") -> DataFrame:
    """The same for query rows: overlap with all days, slots with the chosen window.

    ``stats`` must be taken with ``cutoff_day``, so that it sums both windows.
    """
    if slot_window == "answer":
        return lookup_train(stats, answer_days)
    early = F.col("feature_hits") > 0
    return stats.where("n_hits > 0").select(
        "shop_no",
        "wifi_bssid",
        F.try_divide("feature_signal_sum", "feature_hits").alias("wifi_signal"),
        F.when(early, F.col("feature_hits") / F.lit(feature_days)).alias("sw_number"),
    )


def _scan_probes(rows: DataFrame, slots: int) -> DataFrame:
    """Per row, its distinct access points, each with the set of slots it fills as a bit mask."""
    ranked = rows.select("row_id", hits_of(rows)["wifi_bssid"].alias("_seen"))

    def probe(bssid: Column) -> Column:
        mask = F.lit(0)
        for k in range(slots):
            mask = mask + F.when(F.get("_seen", F.lit(k)) == bssid, F.lit(1 << k)).otherwise(F.lit(0))
        return F.struct(bssid.alias("wifi_bssid"), mask.alias("mask"))

    return ranked.select("row_id", F.transform(F.array_distinct("_seen"), probe).alias("_probes"))


def _seen_points(rows: DataFrame, slots: int) -> DataFrame:
    seen = _scan_probes(rows, slots).select("row_id", F.explode("_probes").alias("_probe"))
    return seen.select("row_id", "_probe.wifi_bssid", "_probe.mask")


def scan_probes(pairs: DataFrame, rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """What pairs ask the lookup: a row for each pair and distinct access point of its scan, with the slots it fills."""
    seen = pairs.select("row_id", "shop_no").join(_scan_probes(rows, slots), "row_id")
    return seen.select("row_id", "shop_no", F.explode("_probes").alias("_probe")).select("row_id", "shop_no", "_probe.wifi_bssid", "_probe.mask")


@dataclass(frozen=True)
class WidePoints:
    """The access points of a lookup that more than a stated number of shops know, and whether there is one."""

    table: DataFrame
    found: bool

    def among(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` at a wide access point."""
        return df.join(self.table, "wifi_bssid", "left_semi")

    def beside(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, "wifi_bssid", "left_anti") if self.found else df


def wide_points(lookup: DataFrame, most_shops: int) -> DataFrame:
    """The access points that more than ``most_shops`` entries of the lookup name."""
    sizes = lookup.groupBy("wifi_bssid").agg(F.count("*").alias("_shops"))
    return sizes.where(F.col("_shops") > most_shops).select("wifi_bssid")


def _point_matches(rows: DataFrame, lookup: DataFrame, slots: int) -> DataFrame:
    """Each access point of a row with every shop that knows it, whether it is a candidate of the row or not."""
    return spread_join(_seen_points(rows, slots), lookup.where(F.col("shop_no").isNotNull()), "wifi_bssid")


def pair_match(
    pairs: DataFrame, rows: DataFrame, lookup: DataFrame, slots: int = SLOTS, known: KnownKeys | None = None,
    wide: WidePoints | None = None, tasks: int | None = None,
) -> DataFrame:
    """Every pair with its slots' expected signals and rates, and the overlap of scan and shop.

    One inner join on (shop, access point) serves all slots and the overlap: what
    a shop does not know goes no further, and with ``known``, a filter of the lookup's keys, most of it is not
    even shuffled to the join. With ``wide``, only its access points are asked for pair by pair. Those few shops know
    are joined by access point alone, so a hit brings few rows however many candidates its row has; what
    they tell about shops that are no candidates is dropped. ``known`` need then hold the keys of wide ones only.

    The pairs themselves, with what they
    carry, meet their matches in one shuffle by row, into ``tasks`` parts where that is given. The overlap is the
    share of the scan's distinct access points known at the shop; it is 0 for an
    empty scan.
    """
    carried = [name for name in pairs.columns if name not in ("row_id", "shop_no")]
    probes = _scan_probes(rows, slots)
    told = ["row_id", "shop_no", "mask", "wifi_signal", "sw_number"]
    met = pairs.withColumn("_pair", F.lit(1))
    if wide:
        met = met.unionByName(_point_matches(rows, wide.beside(lookup), slots).select(*told, F.lit(1).alias("_direct")), allowMissingColumns=True)
    if not wide or wide.found:
        asked, answers = scan_probes(pairs, rows, slots), lookup
        if wide:
            asked = pairs.select("row_id", "shop_no").join(wide.among(_seen_points(rows, slots)), "row_id")
            answers = wide.among(lookup)
        matched = spread_join(known.keep(asked) if known else asked, answers, ["shop_no", "wifi_bssid"])
        met = met.unionByName(matched.select(told), allowMissingColumns=True)

    expected: list[Column] = []
    for k in range(1, slots + 1):
        in_slot = F.col("mask").bitwiseAND(1 << (k - 1)) != 0
        expected.append(F.max(F.when(in_slot, F.col("wifi_signal"))).alias(f"sw_wifi{k}_signal"))
        expected.append(F.max(F.when(in_slot, F.col("sw_number"))).alias(f"sw_number{k}"))
    known_points = F.count("mask")
    if wide:
        # A pair given twice asks twice; what was met by access point alone counts for each.
        known_points = known_points + F.count("_direct") * (F.count("_pair") - 1)
    placed = met.repartition(tasks, "row_id") if tasks else met.repartition("row_id")
    folded = placed.groupBy("row_id", "shop_no").agg(
        *(F.max(name).alias(name) for name in carried), *expected, known_points.alias("_known"), F.count("_pair").alias("_pairs")
    )
    folded = folded.where("_pairs > 0").drop("_pairs")
    sizes = probes.select("row_id", F.size("_probes").alias("_seen"))
    overlap = F.coalesce(F.try_divide("_known", "_seen"), F.lit(0.0)).alias("wifi_in_swifi")
    names = [name for name in folded.columns if name != "_known"]
    return folded.join(sizes, "row_id").select(*names, overlap)


def slot_differences(slots: int = SLOTS) -> dict[str, Column]:
    """Observed minus expected signal per slot."""
    return {
        f"sw_wifi{k}_signal_cha": F.col(f"wifi{k}_signal") - F.col(f"sw_wifi{k}_signal") for k in range(1, slots + 1)
    }
