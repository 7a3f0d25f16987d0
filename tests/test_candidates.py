"""Index and candidate pairs, against brute force and hand-made cases."""

from collections import Counter, defaultdict

import pytest

from aislefix.operators import candidates as c

HIT_SCHEMA = "wifi_bssid bigint, shop_no bigint, wifi_signal int"


def frame(spark, hits):
    return c.ap_signal_pairs(spark.createDataFrame(hits, HIT_SCHEMA))


def as_pairs(df):
    return {(r.wifi_bssid, r.shop_no) for r in df.collect()}


def test_width_counts_pairs_not_shops(spark):
    one_shop = [(1, 7, -50 - i) for i in range(12)] + [(1, 8, -90)] * 3
    assert as_pairs(c.ap_index_train(frame(spark, one_shop), 12, 6)) == {(1, 7)}
    assert as_pairs(c.ap_index_train(frame(spark, one_shop), 13, 6)) == {(1, 7), (1, 8)}


def test_support_of_five_and_six(spark):
    hits = [(1, 7, -50)] * 5 + [(2, 7, -50)] * 6
    assert as_pairs(c.ap_index_train(frame(spark, hits), 12, 6)) == {(2, 7)}


def test_indexes_against_brute_force(spark):
    hits = [(b, (b * 7 + i * i) % 29, -40 - (i * b) % 50) for b in range(1, 9) for i in range(b * 9)]
    strongest, popular, support = defaultdict(set), defaultdict(Counter), Counter()
    for bssid, shop, signal in hits:
        strongest[bssid].add((-signal, shop))
        popular[bssid][shop] += 1
        support[bssid] += 1

    def top(width):
        return {(b, shop) for b, pairs in strongest.items() for _, shop in sorted(pairs)[:width]}

    most = {
        (b, shop) for b, count in popular.items() for shop, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:3]
    }
    train = {(b, shop) for b, shop in top(12) if support[b] >= 10}
    assert as_pairs(c.ap_index_train(frame(spark, hits), 12, 10)) == train
    assert as_pairs(c.ap_index_query(frame(spark, hits), 15, 3)) == top(15) | most


@pytest.fixture(scope="module")
def label_rows(spark):
    rows = [(1, "s_7", "b_1|-50|true;b_2|-60|false"), (2, "s_9", None), (3, "s_8", "b_1|-50|true;b_1|-51|true")]
    return spark.createDataFrame(rows, "row_id bigint, shop_id string, wifi_infos string")


def test_train_pairs(spark, label_rows):
    index = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "wifi_bssid bigint, shop_no bigint")
    guesses = [(1, "s_8", 0, 0), (1, "s_3", 0, 1), (2, "s_4", 0, 0), (99, "s_4", 1, 0), (3, None, 0, 0)]
    prior = spark.createDataFrame(guesses, "row_id bigint, shop_id string, label int, shop_index int")
    got = sorted(tuple(r) for r in c.candidate_union_train(label_rows, index, prior).collect())
    # Each label row has its true pair, also where the scan is missing; pairs are unique.
    assert got == [(1, 7, 1), (1, 8, 0), (2, 4, 0), (2, 9, 1), (3, 7, 0), (3, 8, 1)]
    recall = c.candidate_recall(label_rows, index).first()
    assert (recall.label_rows, recall.index_pairs, recall.true_pairs) == (3, 4, 2)


def test_query_pairs_leave_out_rows_without_candidates(spark, label_rows):
    index = spark.createDataFrame([(2, 8)], "wifi_bssid bigint, shop_no bigint")
    prior = spark.createDataFrame([(2, "s_5", 0)], "row_id bigint, shop_id string, shop_index int")
    got = sorted(tuple(r) for r in c.candidate_union_query(label_rows, index, prior).collect())
    assert got == [(1, 8), (2, 5)]
