"""The state by day beside a whole pass, with ties, single days and days added again."""

import random

import pytest
from pyspark.sql import functions as F

from aislefix.operators import candidates, daily, profiles
from aislefix.operators.hits import visit_hits
from aislefix.plans.pipeline import Positioning
from aislefix.sources.adapter import load_tables


def made_visits(spark, seed=1, rows=400):
    rng = random.Random(seed)
    made = []
    for i in range(rows):
        scan = ";".join(f"b_{rng.randrange(6)}|{-50 - rng.randrange(3)}|true" for _ in range(rng.randrange(5))) or None
        made.append((i, f"s_{rng.randrange(9)}", f"2017-08-{rng.randrange(1, 32):02} 10:00", scan))
    frame = spark.createDataFrame(made, "row_id bigint, shop_id string, time_stamp string, wifi_infos string")
    return frame.withColumn("time_stamp", F.col("time_stamp").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def visits(spark):
    return made_visits(spark)


@pytest.fixture(scope="module")
def state(spark, visits, tmp_path_factory):
    """Days added alone or some together, in no order, and some twice."""
    found = daily.DayState(spark, str(tmp_path_factory.mktemp("days")), width=8)
    for days in ([30], range(11, 25), [7], range(25, 32), [3, 7], range(1, 11), [12]):
        found.add(visits, days)
    return found


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("until", [1, 10, 24, 31])
@pytest.mark.parametrize("support", [1, 30])
def test_any_window_is_a_merge(visits, state, until, support):
    hits = visit_hits(visits).where(F.col("transaction_day") <= until)
    assert rows(daily.merged_stats(state.sums(until), support)) == rows(profiles.ap_stats(hits, support))


def test_two_windows_at_once(visits, state):
    assert rows(daily.merged_stats(state.sums(), 1, 24)) == rows(profiles.ap_stats(visit_hits(visits), 1, 24))


def brute_force(visits, until, width):
    pairs = {}
    for r in visit_hits(visits).where(F.col("transaction_day") <= until).collect():
        pairs.setdefault(r.wifi_bssid, set()).add((-r.wifi_signal, r.shop_no))
    return sorted({(ap, shop) for ap, found in pairs.items() for _, shop in sorted(found)[:width]})


@pytest.mark.parametrize("until, width", [(3, 8), (24, 5), (31, 8), (31, 1)])
def test_the_index_of_merged_days_is_exact(visits, state, until, width):
    found = daily.merged_pairs(state.best(width, until))
    got = candidates.ap_index_train(found, width, 1, daily.merged_counts(state.sums(until)))
    assert sorted((r.wifi_bssid, r.shop_no) for r in got.collect()) == brute_force(visits, until, width)


def test_most_frequent_shops_and_support(visits, state):
    pairs = candidates.ap_signal_pairs(visit_hits(visits))
    found, counts = daily.merged_pairs(state.best(5)), daily.merged_counts(state.sums())
    assert rows(candidates.ap_index_query(found, 5, 2, counts)) == rows(candidates.ap_index_query(pairs, 5, 2))
    for least in (50, 120, 150):
        assert rows(candidates.ap_index_train(found, 5, least, counts)) == rows(candidates.ap_index_train(pairs, 5, least))


def test_wider_than_stored_is_refused(state):
    with pytest.raises(ValueError, match="keeps 8"):
        state.best(9)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_added_day_reads_that_day_and_a_window_its_days(spark, state, sf_dir):
    p = Positioning(load_tables(spark, sf_dir, stored=True), stored=True)
    one = p.tables.visits.where(F.col("transaction_day").isin([25]))
    assert "transaction_day" in plan_of(daily.daily_sums(visit_hits(one))).split("PartitionFilters: [")[1].split("]")[0]
    assert "transaction_day" in plan_of(state.sums(24)).split("PartitionFilters: [")[1].split("]")[0]


def test_no_visits(spark, visits, tmp_path):
    none = daily.DayState(spark, str(tmp_path)).add(visits.limit(0))
    assert daily.merged_stats(none.sums()).count() == 0 and none.best(3).count() == 0
