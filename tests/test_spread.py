"""Hot keys are split at run time, and the join still gives the same rows."""

import pytest
from pyspark.sql import functions as F

from aislefix.operators.spread import spread_join

SKEW = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def small_thresholds(spark):
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_key_with_a_third_of_the_rows_is_split(spark, small_thresholds, how):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    big = spark.range(0, 400_000, 1, 8).select("id", key.alias("k"))
    per_key = big.where("k < 900").groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(big, per_key, "k", how)
    totals = joined.agg(F.count("*"), F.sum("n"), F.sum("id"))
    got = totals.collect()
    assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    assert got == big.join(per_key, "k", how).agg(F.count("*"), F.sum("n"), F.sum("id")).collect()


def test_null_keys_survive_a_left_join(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "id bigint, k bigint")
    right = spark.createDataFrame([(5, "x")], "k bigint, v string")
    assert sorted(tuple(r) for r in spread_join(left, right, "k", "left").select("id", "v").collect()) == [
        (1, None), (2, "x"),
    ]


def test_keys_of_different_type_are_refused(spark):
    left, right = spark.range(1), spark.createDataFrame([(0,)], "id int")
    with pytest.raises(TypeError):
        spread_join(left, right, "id")


def test_the_extra_key_takes_a_byte(spark):
    left = spark.range(5000).select(F.col("id").alias("k"))
    joined = spread_join(left, left.withColumn("v", F.lit(1)), "k")
    keys = joined._jdf.queryExecution().analyzed().toString()
    assert "shiftrightunsigned(xxhash64" in keys and joined.count() == 5000
