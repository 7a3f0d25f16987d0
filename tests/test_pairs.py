"""Slot features, overlap, encoder and ranking on hand-made rows."""

import itertools
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from aislefix.operators import encode, pairs
from aislefix.operators.known import KnownSettings
from aislefix.operators.ranking import best_candidate
from aislefix.plans.pipeline import Positioning
from aislefix.plans.registry import load_tables, published
from aislefix.sources.tables import materialize

LOOKUP = "shop_no bigint, wifi_bssid bigint, wifi_signal double, sw_number double"


@pytest.fixture(scope="module")
def matched(spark):
    rows = spark.createDataFrame(
        [(1, "b_5|-70|true;b_6|-60|false;b_5|-80|false"), (2, None)], "row_id bigint, wifi_infos string"
    )
    wanted = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7)], "row_id bigint, shop_no bigint")
    lookup = spark.createDataFrame([(7, 5, -71.5, 0.5), (7, 6, None, None), (8, 6, -61.0, 2.0)], LOOKUP)
    return {(r.row_id, r.shop_no): r for r in pairs.pair_match(wanted, rows, lookup).collect()}


def test_every_pair_is_kept(matched):
    assert set(matched) == {(1, 7), (1, 8), (1, 9), (2, 7)}


def test_a_repeated_access_point_fills_both_slots_but_counts_once(matched):
    row = matched[1, 7]
    assert (row.sw_wifi1_signal, row.sw_wifi2_signal, row.sw_wifi3_signal) == (None, -71.5, -71.5)
    assert row.sw_number2 == 0.5 and row.wifi_in_swifi == 1.0
    assert matched[1, 8].wifi_in_swifi == 0.5 and matched[1, 8].sw_wifi1_signal == -61.0


def test_unknown_shop_and_empty_scan_have_no_overlap(matched):
    assert matched[1, 9].wifi_in_swifi == 0.0 and matched[2, 7].wifi_in_swifi == 0.0
    assert matched[2, 7].sw_wifi1_signal is None


def test_lookup_of_query_rows_mixes_two_windows(spark):
    stats = spark.createDataFrame(
        [(7, 5, 4, -200, 3, -150), (7, 6, 1, -90, 0, None)],
        "shop_no bigint, wifi_bssid bigint, n_hits bigint, signal_sum bigint, feature_hits bigint, feature_signal_sum bigint",
    )
    early = {r.wifi_bssid: r for r in pairs.lookup_query(stats, 24, 31).collect()}
    assert (early[5].wifi_signal, early[5].sw_number) == (-50.0, 3 / 24)
    assert (early[6].wifi_signal, early[6].sw_number) == (None, None)
    late = {r.wifi_bssid: r for r in pairs.lookup_query(stats, 24, 31, "answer").collect()}
    assert (late[6].wifi_signal, late[6].sw_number) == (-90.0, 1 / 31)


@pytest.mark.parametrize("bits", [2, 5, 22])
def test_dense_codes_against_sorting(spark, bits):
    draw = random.Random(7)
    values = {name: [draw.choice((-999, draw.randrange(40), draw.randrange(1 << 50))) for _ in range(300)] for name in "ab"}
    rows = [(name, value) for name, column in values.items() for value in column]
    distinct = encode.distinct_values(spark.createDataFrame(rows, "name string, value bigint"))
    got = encode.dense_codes(distinct, bits).collect()
    for name, column in values.items():
        want = {value: code for code, value in enumerate(sorted(set(column)))}
        assert {r.value: r.code for r in got if r.name == name} == want


def test_encoder_spans_both_sides_and_keeps_rows(spark):
    schema = "row_id bigint, mall_no bigint, wifi1_bssid bigint"
    train = spark.createDataFrame([(1, 40, 9), (2, None, -999)], schema)
    query = spark.createDataFrame([(3, 30, 5)], schema)
    names = ["mall_no", "wifi1_bssid"]
    codes = encode.ordinal_codes(train.unionByName(query), names)
    got = {r.row_id: (r.mall_no_code, r.wifi1_bssid_code) for r in encode.ordinal_encode(train, codes, names).collect()}
    assert got == {1: (1, 2), 2: (None, 0)}


def test_negative_ids_are_refused(spark):
    rows = spark.createDataFrame([(1, 40, -1000)], "row_id bigint, mall_no bigint, wifi1_bssid bigint")
    with pytest.raises(Exception, match="negative id: -1000"):
        encode.ordinal_codes(rows, ["mall_no", "wifi1_bssid"]).collect()


def test_rows_without_a_key_are_numbered(spark):
    rows = [(f"u_{i % 40}", None if i % 7 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, wifi_infos string").repartition(9)
    got = sorted(tuple(r) for r in encode.numbered(df).collect())
    assert [r[0] for r in got] == list(range(300))
    key = lambda r: (r[0], r[1] is not None, r[1])
    assert [r[1:] for r in got] == sorted(rows, key=key)
    assert encode.numbered(df.limit(0)).count() == 0


def test_row_numbers_are_dense(spark):
    rows = spark.createDataFrame([(70,), (5,), (1 << 40,)], "row_id bigint")
    assert sorted((r.row_id, r.row_number) for r in encode.row_numbers(rows, "row_id").collect()) == [
        (5, 0), (70, 1), (1 << 40, 2),
    ]


def test_best_candidate_breaks_ties_by_shop_number(spark):
    scored = spark.createDataFrame(
        [(1, 10, 0.5), (1, 9, 0.5), (1, 2, 0.1), (2, 4, 0.0)], "row_id bigint, shop_no bigint, score double"
    )
    got = {r.row_id: r.shop_id for r in best_candidate(scored, F.col("score")).collect()}
    assert got == {1: "s_9", 2: "s_4"}


def test_numbers_of_many_ranges(spark):
    """20,000 ranges: starts are joined, not compared one by one."""
    dealt = spark.range(50_000).selectExpr("CAST(id * 2 DIV 5 AS INT) AS part", "id * 7 AS value")
    got = encode.number_ranges(dealt, "part", ["value"], "row_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "map(" not in plan and "Join" in plan
    assert got.where("row_id * 7 <> value").count() == 0 and got.select("row_id").distinct().count() == 50_000


def test_few_shops_are_met_by_access_point_with_the_same_matches(spark):
    """Access point 6 is wide and asked pair by pair; 5 and 4 are met by themselves, also at shops that are no candidates."""
    rows = spark.createDataFrame(
        [(1, "b_5|-70|true;b_6|-60|false;b_5|-80|false"), (2, None), (3, "b_4|-50|true"), (3, "b_4|-50|true"), (None, "b_5|-1|true")],
        "row_id bigint, wifi_infos string",
    )
    wanted = [(1, 7, "x"), (1, 7, "a"), (1, 8, None), (1, 9, "y"), (2, 7, "z"), (3, 7, "w"), (3, None, "n"), (None, 7, "n")]
    wanted = spark.createDataFrame(wanted, "row_id bigint, shop_no bigint, carried string")
    lookup = [(s, 6, -60.0 - s, 2.0) for s in range(7, 12)] + [(7, 5, -71.5, 0.5), (99, 5, -1.0, 1.0), (7, 4, None, None), (None, 4, 1.0, 1.0)]
    lookup = spark.createDataFrame(lookup, LOOKUP)
    tidy = lambda df: sorted(map(str, df.collect()))
    want = tidy(pairs.pair_match(wanted, rows, lookup))
    assert len(want) == 8
    for most in (0, 2, 100):
        found = pairs.wide_points(lookup, most)
        wide = pairs.WidePoints(found, not found.isEmpty())
        got = pairs.pair_match(wanted, rows, lookup, wide=wide, tasks=3)
        assert tidy(got) == want and got.columns == pairs.pair_match(wanted, rows, lookup).columns
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "[shop_no" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_a_task_folds_a_bounded_number_of_pairs(spark, sf_dir):
    tables = load_tables(spark, sf_dir, True)
    plain = Positioning(tables, stored=True)
    sized = Positioning(tables, stored=True, filters=KnownSettings(direct_from=1, pairs_per_task=50))
    assert sized.answer_wide and not plain.answer_wide
    parts = 1 + sized.answer_pairs.count() // 50
    plan = sized.answer_match._jdf.queryExecution().sparkPlan().toString()
    assert f", {parts}), REPARTITION_BY_NUM" in plan
    tidy = lambda df: sorted(map(str, df.collect()))
    assert tidy(sized.answer_match) == tidy(plain.answer_match)


def _wide_shuffles(df) -> list[str]:
    """Shuffles by row whose input holds a column of the shop."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [re.search(r"[A-Z]", line).start() for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "RepartitionByExpression [row_id" in line:
            below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
            found += [line] if any("slongitude" in lines[j] for j in below) else []
    return found


def _read_all(method):
    found = {name: getattr(method, name) for name in ("train_pair_columns", "answer_pair_columns")}
    return {name: sorted(map(str, published(df.select(sorted(df.columns))).collect())) for name, df in found.items()}


def test_shops_meet_pairs_after_the_match_with_the_same_columns(spark, sf_dir):
    """Few shops are not shuffled with the pairs; a shop given twice counts the matches of its pairs twice either way."""
    tables = load_tables(spark, sf_dir, True)
    tables = replace(tables, shops=materialize(tables.shops.unionByName(tables.shops.where("shop_id IN ('s_1', 's_2')")), "shops"))
    few = Positioning(tables, stored=True)
    many = Positioning(tables, stored=True, filters=KnownSettings(most_shops=0))
    assert not _wide_shuffles(few.answer_features) and _wide_shuffles(many.answer_features)
    assert _read_all(few) == _read_all(many)
    assert few.answer_pair_columns.agg(F.max("wifi_in_swifi")).head()[0] > 1


def test_folded_pairs_are_not_shuffled_again(spark, sf_dir):
    """Parts fewer than the session's would be dealt out once more for the join by row, all pairs with their matches."""
    method = Positioning(load_tables(spark, sf_dir, True), stored=True)
    assert method._tasks(method.answer_pairs) is None
    plan = method.answer_match._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and "REPARTITION_BY_COL" in plan
