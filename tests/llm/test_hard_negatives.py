"""Hard negatives beside a plain search."""

import math
import random

import numpy as np
import pytest
from check_oracle import connect, difference

import __spark_entry__ as driver
from aislefix.llm import hard_negatives
from aislefix.llm.hard_negatives import MiningSettings, mine_hard_negatives


def plain(rows, is_anchor, s):
    sound = [
        (i, label, [math.floor(s.scale * x) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, label, v in sorted(sound):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    result = []
    for anchor, (label, v) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in sound if i != anchor]
        positives = sorted((x[0], x[1]) for x in scored if x[2] == label)[: s.positives]
        negatives = sorted((x[0], x[1]) for x in scored if x[2] != label)
        for negated, positive in positives:
            p = -negated
            inside = [(-n, i) for n, i in negatives if s.low * p <= -100 * n <= s.high * p][: s.negatives]
            result += [(anchor, positive, rank, i, p, n) for rank, (n, i) in enumerate(inside, 1)]
    return sorted(result)


def made(seed, count=300, width=4, spread=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.randrange(-spread, spread + 1) / 4 for _ in range(width)]) for i in range(count)]
    rows += [(None, 1, [1.0] * width), (count, None, [1.0] * width), (count + 1, 1, None), (count + 2, 1, [1.0, None]),
             (count + 3, 0, [math.nan] * width), (count + 4, 0, [math.inf] * width), (count + 6, 2, []), (count + 5, 2, [1.0])]
    return rows + rows[3:9] + [(20, 2, [0.5] * width)] * 2 + [(1000 + i, 1, [0.75] * width) for i in range(80)]


def frame(spark, rows, parts=4):
    more = [(i, label, v, 0, 1.0) for i, label, v in rows]
    df = spark.createDataFrame(more, "vec_id bigint, label int, embedding array<double>, score int, place double")
    return df.repartition(parts)


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 15), (2, 37), (3, 5)])
def test_equals_plain_search(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(hard_negatives, "_CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "_SCORES", 100 * chunk)
    rows = made(seed)
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in mine_hard_negatives(df, df.vec_id % 10 == 0).collect())
    assert got == plain(rows, lambda i: i % 10 == 0, MiningSettings()) and len(got) > 100


def test_other_settings_with_ties_everywhere(spark):
    rows = [(i, i % 2, [1.0, float(i % 3)]) for i in range(60)]
    s = MiningSettings(scale=1, positives=3, negatives=4, low=10, high=100)
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in mine_hard_negatives(df, df.vec_id < 4, settings=s).collect())
    assert got == plain(rows, lambda i: i < 4, s)


def test_large_components_stay_exact():
    a, b = np.array([[2.0**31, 1.0]]), np.array([[2.0**30, 1.0], [2.0**31 - 1, 3.0]])
    assert hard_negatives.inner_products(a, b).tolist() == [[2**61 + 1, 2**31 * (2**31 - 1) + 3]]
    with pytest.raises(OverflowError):
        hard_negatives.inner_products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_one_label_one_row_and_empty_tables(spark):
    for rows in ([], [(0, 1, [1.0])], [(i, 1, [1.0]) for i in range(30)]):
        df = frame(spark, rows, 1)
        assert mine_hard_negatives(df, df.vec_id % 10 == 0).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    df = driver.queries()["op11_hard_negatives"](spark, sf_dir)
    assert difference(df, connect(sf_dir), "op11_hard_negatives") is None and df.count()
