"""Profiles on hand-made visits."""

import pytest
from pyspark.sql import functions as F

from aislefix.operators import profiles
from aislefix.operators.hits import visit_hits, with_min_support

VISITS = [
    # Shop 1: access points 10 and 11 both seen twice; 11 is stronger. 12 once, strongest of its scan.
    (1, "s_1", "2017-08-01 10:00", "b_10|-80|true;b_11|-70|false"),
    (2, "s_1", "2017-08-02 10:00", "b_10|-80|true;b_11|-72|false;b_12|-50|false"),
    # Shop 2: access points 20 and 21 fully tied.
    (3, "s_2", "2017-08-24 10:00", "b_21|-60|true;b_20|-60|false"),
    # Shop 3: only after the cutoff.
    (4, "s_3", "2017-08-25 10:00", "b_10|-55|true"),
]


@pytest.fixture(scope="module")
def hits(spark):
    rows = spark.createDataFrame(VISITS, "row_id bigint, shop_id string, time_stamp string, wifi_infos string")
    return visit_hits(rows.withColumn("time_stamp", F.col("time_stamp").cast("timestamp_ntz")))


def by_shop(df):
    return {row.shop_no: row for row in df.collect()}


def test_modal_access_points(hits):
    stats = profiles.ap_stats(hits.where("transaction_day <= 24"))
    modal = by_shop(profiles.shop_modal_ap(stats))
    assert (modal[1].swifi_bssid_maxsignal, modal[1].swifi_signal_maxsignal) == (11, -71.0)
    assert (modal[2].swifi_bssid_maxsignal, modal[2].swifi_signal_maxsignal) == (20, -60.0)
    assert 3 not in modal
    ties = {(r.shop_no, r.wifi_bssid) for r in profiles.shop_modal_ap_ties(stats).collect()}
    assert ties == {(1, 10), (1, 11), (2, 20), (2, 21)}


def test_strongest_hits(hits):
    stats = profiles.ap_stats(hits)
    assert by_shop(profiles.shop_slot1_mean(stats))[1].swifi1_signal_all == -60.0
    assert by_shop(profiles.shop_slot1_variety(stats, 31))[1].shop_wifi_num == 2 / 31
    modal = by_shop(profiles.shop_slot1_modal_ap(stats))
    assert (modal[1].swifi1_bssid_maxsignal, modal[1].swifi1_signal_maxsignal) == (12, -50.0)
    # Equal signals: the first of the scan is the strongest hit.
    assert modal[2].swifi1_bssid_maxsignal == 21


def test_one_pass_sums_both_windows(hits):
    both = {(r.shop_no, r.wifi_bssid): r for r in profiles.ap_stats(hits, cutoff_day=24).collect()}
    assert (both[1, 10].n_hits, both[1, 10].feature_hits, both[1, 10].feature_signal_sum) == (2, 2, -160)
    assert (both[3, 10].n_hits, both[3, 10].feature_hits, both[3, 10].feature_signal_sum) == (1, 0, None)


def test_shop_profile_equals_its_parts(hits):
    stats = profiles.ap_stats(hits)
    whole = by_shop(profiles.shop_profile(stats, 31))
    for part in (
        profiles.shop_modal_ap(stats), profiles.shop_mean_signal(stats), profiles.shop_slot1_mean(stats),
        profiles.shop_slot1_variety(stats, 31), profiles.shop_slot1_modal_ap(stats),
    ):
        for shop, row in by_shop(part).items():
            for name in part.columns:
                assert whole[shop][name] == row[name]


def test_no_access_point_of_a_large_shop_is_lost(spark):
    many = spark.range(6000).selectExpr("id AS row_id", "1L AS shop_no", "1 AS transaction_day", "1 AS k", "1 AS pos", "id * 1000 AS wifi_bssid", "-50 AS wifi_signal")
    stats = profiles.ap_stats(many)
    assert profiles.shop_ap_list(stats).distinct().count() == 6000
    assert profiles.shop_profile(stats, 24).count() == 1


def test_min_support_spares_strongest_hit_columns(hits):
    stats = profiles.ap_stats(hits, min_support=2)
    seen = {(r.shop_no, r.wifi_bssid) for r in profiles.ap_profile(stats, 31).collect()}
    assert seen == {(1, 10), (1, 11), (3, 10)}
    assert by_shop(profiles.shop_slot1_modal_ap(stats))[1].swifi1_bssid_maxsignal == 12
    assert set(by_shop(profiles.shop_profile(stats, 31))) == {1, 3}
    kept = with_min_support(hits, 2).collect()
    assert {(r.row_id, r.wifi_bssid, r.wifi_counts) for r in kept} == {
        (1, 10, 3), (2, 10, 3), (4, 10, 3), (1, 11, 2), (2, 11, 2),
    }
