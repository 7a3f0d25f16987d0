"""Visits and query rows with calendar, mall distances and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislefix.functions.calendar import calendar_columns
from aislefix.functions.geo import equator_arc, great_circle
from aislefix.functions.ids import id_number
from aislefix.functions.scans import hits_of, slot_columns
from aislefix.operators.spread import spread_join
from aislefix.settings import SLOTS

SLOT_COLUMNS = [f"wifi{k}_{part}" for k in range(1, SLOTS + 1) for part in ("bssid", "signal", "flag")]


def shop_dimension(shops: DataFrame) -> DataFrame:
    """Shop attributes under the names they have beside a visit."""
    return shops.select(
        "shop_id",
        id_number("category_id").alias("category_id"),
        F.col("longitude").alias("slongitude"),
        F.col("latitude").alias("slatitude"),
        "price",
        "mall_id",
    )


def visit_shop_join(visits: DataFrame, shops: DataFrame) -> DataFrame:
    """Every visit with its shop's mall, place and price."""
    places = shops.select(
        "shop_id",
        "mall_id",
        F.col("longitude").alias("slongitude"),
        F.col("latitude").alias("slatitude"),
        "price",
    )
    return spread_join(visits, places, "shop_id", "left")


def mall_profile(visits: DataFrame, shops: DataFrame) -> DataFrame:
    """Mean price and place per mall, each shop weighted by its visits.

    Visits are counted per shop first, so only one row per shop is joined.
    """
    counted = visits.groupBy("shop_id").agg(F.count("*").alias("n")).join(shops, "shop_id")

    def weighted_mean(name: str):
        value = F.col(name)
        return F.sum(value * F.col("n")) / F.sum(F.when(value.isNotNull(), F.col("n")))

    return (
        counted.where(F.col("mall_id").isNotNull())
        .groupBy("mall_id")
        .agg(
            weighted_mean("price").alias("mall_price"),
            weighted_mean("longitude").alias("mall_longitude"),
            weighted_mean("latitude").alias("mall_latitude"),
        )
    )


def _with_distances(rows: DataFrame) -> DataFrame:
    lon, lat = F.col("longitude"), F.col("latitude")
    mall_lon, mall_lat = F.col("mall_longitude"), F.col("mall_latitude")
    return rows.withColumns(
        {
            "distance": great_circle(lon, lat, mall_lon, mall_lat),
            "longitude1": equator_arc(lon, mall_lon),
            "latitude1": equator_arc(lat, mall_lat),
        }
    ).drop("mall_longitude", "mall_latitude")


def visits_with_mall(visits: DataFrame, shops: DataFrame) -> DataFrame:
    """Visits with mall and distances; the centre is joined to the shops, so visits are joined once."""
    centres = mall_centres(visits, shops)
    places = shops.select("shop_id", "mall_id").join(centres, "mall_id", "left")
    return _with_distances(spread_join(visits, places, "shop_id", "left"))


def mall_centres(visits: DataFrame, shops: DataFrame) -> DataFrame:
    return mall_profile(visits, shops).drop("mall_price")


def query_rows_with_mall(query_rows: DataFrame, centres: DataFrame) -> DataFrame:
    return _with_distances(spread_join(query_rows, centres, "mall_id", "left"))


def with_calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumns(calendar_columns("time_stamp"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Hit count and the ten strongest hits as flat columns."""
    return (
        rows.withColumn("_ranked", hits_of(rows))
        .withColumn("wifi_infos_number", F.size("_ranked"))
        .withColumns(slot_columns("_ranked"))
        .drop("_ranked", "hits")
    )


def enrich_visits(visits: DataFrame, shops: DataFrame) -> DataFrame:
    return with_slots(with_calendar(visits_with_mall(visits, shops))).drop("time_stamp")


def enrich_query_rows(query_rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``centres``: see ``mall_centres``."""
    return with_slots(with_calendar(query_rows_with_mall(query_rows, centres))).drop("time_stamp")
