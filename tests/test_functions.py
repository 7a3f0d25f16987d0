import math
from datetime import datetime

from pyspark.sql import functions as F

from aislefix.functions.calendar import calendar_columns
from aislefix.functions.geo import equator_arc, great_circle
from aislefix.functions.ids import id_number, with_prefix


def test_ids_both_ways(spark):
    row = spark.createDataFrame([("s_12", "b_-999", None)], "a string, b string, c string").select(
        id_number("a").alias("a"), id_number("b").alias("b"), id_number("c").alias("c"),
        with_prefix("s", id_number("a")).alias("t"), with_prefix("s", id_number("c")).alias("n"),
    ).first()
    assert tuple(row) == (12, -999, None, "s_12", None)


def test_calendar_of_monday_and_sunday(spark):
    days = [(datetime(2017, 8, 7, 21, 5),), (datetime(2017, 8, 13, 0, 59),)]
    got = spark.createDataFrame(days, "t timestamp_ntz").select(*calendar_columns("t").values()).collect()
    assert [tuple(r) for r in got] == [(7, 21, 5, 1), (13, 0, 59, 7)]


def test_distances_against_plain_arithmetic(spark):
    lon_a, lat_a, lon_b, lat_b = 113.2, 23.1, 113.25, 23.05
    values = [F.lit(v) for v in (lon_a, lat_a, lon_b, lat_b)]
    got = spark.range(1).select(
        great_circle(*values).alias("d"), equator_arc(values[0], values[2]).alias("x")
    ).first()
    a, b, c, d = map(math.radians, (lon_a, lat_a, lon_b, lat_b))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    assert math.isclose(got.d, 2 * 6371000 * math.asin(math.sqrt(h)), rel_tol=1e-9)
    assert math.isclose(got.x, 6371000 * math.radians(0.05), rel_tol=1e-9)


def test_arcs_go_the_short_way_round(spark):
    east, west = F.lit(179.9), F.lit(-179.9)
    got = spark.range(1).select(equator_arc(east, west).alias("x")).first()
    assert math.isclose(got.x, 6371000 * math.radians(0.2), rel_tol=1e-6)
