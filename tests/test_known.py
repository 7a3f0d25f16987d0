"""The filter of known keys: it keeps every known key, few others, and stays out of the way beyond its bounds."""

import pytest
from pyspark.sql import functions as F

from aislefix.operators import pairs
from aislefix.operators.known import KnownSettings, known_keys
from aislefix.plans.pipeline import Positioning
from aislefix.plans.registry import load_tables

ANY = KnownSettings(least_keys=1)


def keyed(spark, count, start=0):
    return spark.range(start, start + count).select((F.col("id") % 97).alias("shop_no"), (F.col("id") * 7).alias("wifi_bssid"), "id")


@pytest.mark.parametrize("count", [1, 40, 341, 342, 20_000])
def test_every_known_key_and_few_others_pass(spark, count):
    found = known_keys(keyed(spark, count), ["shop_no", "wifi_bssid"], ANY)
    kept = found.keep(keyed(spark, count + 20_000))
    assert kept.columns == ["shop_no", "wifi_bssid", "id"]
    ids = [r.id for r in kept.collect()]
    assert len(set(ids)) == len(ids) and set(range(count)) <= set(ids)
    assert len(ids) - count < 0.04 * 20_000


def test_nulls_pass_no_filter_and_repeats_change_nothing(spark):
    schema = "shop_no bigint, wifi_bssid bigint"
    keys = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (3, None)], schema)
    found = known_keys(keys, ["shop_no", "wifi_bssid"], ANY)
    assert found.keep(keys).collect() == [(1, 2), (1, 2)]


def test_no_filter_beyond_its_bounds(spark):
    on = ["shop_no", "wifi_bssid"]
    assert known_keys(keyed(spark, 1000), on) is None
    assert known_keys(keyed(spark, 1000), on, KnownSettings(least_keys=1, most_bytes=512)) is None
    assert known_keys(keyed(spark, 0), on, KnownSettings(least_keys=0)) is None


def test_a_filter_changes_no_match_and_drops_probes_before_their_shuffle(spark, sf_dir):
    """With broadcasts left to the filter alone, the probes meet it below the exchange that takes them to the lookup."""
    tables = load_tables(spark, sf_dir, True)
    plain, filtered = Positioning(tables, stored=True), Positioning(tables, stored=True, filters=ANY)
    assert plain.answer_known is None and filtered.answer_known is not None
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        want, got = plain.answer_match, filtered.answer_match
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin [_block") == 1 and "BroadcastHashJoin [_block" not in want._jdf.queryExecution().sparkPlan().toString()
        tidy = lambda df: sorted(map(str, df.collect()))
        assert tidy(got) == tidy(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    asked = pairs.scan_probes(filtered.answer_pairs, tables.query_rows)
    met = asked.join(filtered.answer_lookup, ["shop_no", "wifi_bssid"], "left_semi").count()
    kept = filtered.answer_known.keep(asked).count()
    assert met <= kept <= met + 0.04 * asked.count()
