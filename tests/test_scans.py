"""Scan text: order, padding, missing scans, repeats."""

import pytest

from aislefix.functions.scans import ranked_hits, scan_size, slot_columns
from aislefix.operators.enrich import with_slots
from aislefix.operators.hits import explode_hits, visit_hits

SCANS = [
    (1, "b_5|-70|false;b_6|-60|true;b_7|-70|true"),
    (2, ";".join(f"b_{i}|-{50 + i}|false" for i in range(12))),
    (3, None),
    (4, "b_9|-40|false;b_9|-45|true"),
]


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame(SCANS, "row_id bigint, wifi_infos string")


def test_equal_signals_keep_scan_order(scans):
    hits = explode_hits(scans.where("row_id = 1"), ["row_id"]).orderBy("k").collect()
    assert [(h.k, h.pos, h.wifi_bssid, h.wifi_signal, h.wifi_flag) for h in hits] == [
        (1, 2, 6, -60, 1), (2, 1, 5, -70, 0), (3, 3, 7, -70, 1),
    ]


def test_sizes(scans):
    got = {r.row_id: r.n for r in scans.select("row_id", scan_size("wifi_infos").alias("n")).collect()}
    assert got == {1: 3, 2: 12, 3: 0, 4: 2}


def test_slots_are_cut_at_ten_and_padded(scans):
    rows = {r.row_id: r for r in with_slots(scans).collect()}
    assert [rows[2][f"wifi{k}_bssid"] for k in range(1, 11)] == list(range(10))
    assert [rows[1][f"wifi{k}_signal"] for k in range(1, 6)] == [-60, -70, -70, -999, -999]
    assert (rows[3].wifi1_bssid, rows[3].wifi1_signal, rows[3].wifi1_flag) == (-999, -999, 0)
    assert rows[2].wifi_infos_number == 12


def test_missing_scan_has_no_hits_and_all_hits_are_exploded(scans):
    counts = {r.row_id: r["count"] for r in explode_hits(scans, ["row_id"]).groupBy("row_id").count().collect()}
    assert counts == {1: 3, 2: 12, 4: 2}


def test_slots_never_get_stronger(scans):
    slots = scans.withColumn("r", ranked_hits("wifi_infos")).withColumns(slot_columns("r")).collect()
    for row in slots:
        signals = [row[f"wifi{k}_signal"] for k in range(1, 11)]
        assert signals == sorted(signals, reverse=True)


@pytest.mark.parametrize("scan", ["b_1|-50|TRUE", "b_1|-50|yes", "b_1|-50", "b_1|-50|true|x", "b_1|x|true", "b_1|-50|true;;b_2"])
def test_malformed_hits_fail(spark, scan):
    rows = spark.createDataFrame([(1, scan)], "row_id bigint, wifi_infos string")
    with pytest.raises(Exception, match="not a hit|CAST_INVALID_INPUT"):
        explode_hits(rows, ["row_id"]).collect()


def test_visits_without_a_shop_have_no_hits(spark):
    rows = spark.sql("SELECT 1L AS row_id, CAST(NULL AS string) AS shop_id, timestamp_ntz'2017-08-01' AS time_stamp, 'b_1|-50|true' AS wifi_infos")
    assert visit_hits(rows).count() == 0
