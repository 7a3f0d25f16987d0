"""Positioning tables derived from a TPC-H-like order schema (see FIXTURES.md).

An order stands for one record of the feed: its lines are the hits of one WiFi
scan, the supplier of its strongest line is the shop. Pending orders are the
rows to be answered, the others are visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislefix.functions.ids import with_prefix
from aislefix.functions.scans import with_hits
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import Tables, materialize


def load_tables(spark: SparkSession, sf_dir: str, stored: bool = False) -> Tables:
    """The tables as lazy plans over the source, or over one stored copy of the derived rows.

    Queries that read visits many times should ask for the stored copy.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    shops = _shops(table("supplier"))
    rows = _rows(table("orders"), _scans(table("lineitem")), shops)
    days, scan = [], "wifi_infos"
    if stored:
        # By side and day: windows of either side then read only their own files. Scans are parsed here, once.
        days, scan = ["transaction_day"], "hits"
        rows = with_hits(rows).withColumn("transaction_day", F.dayofmonth("time_stamp"))
        rows = materialize(rows, "rows", ("o_orderstatus", "transaction_day"))
    visits = rows.where((F.col("o_orderstatus") != "P") & F.col("shop_id").isNotNull()).select(
        "row_id", "user_id", "shop_id", "time_stamp", "longitude", "latitude", scan, *days
    )
    query_rows = rows.where(F.col("o_orderstatus") == "P").select(
        "row_id", "user_id", "mall_id", "time_stamp", "longitude", "latitude", scan
    )
    pending = F.col("o_orderstatus") == "P"
    return Tables(shops, visits, query_rows, _prior(rows.where(~pending)), _prior(rows.where(pending)).drop("label"))


def _shops(supplier: DataFrame) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return supplier.select(
        with_prefix("s", key).alias("shop_id"),
        with_prefix("c", key % 13).alias("category_id"),
        (110 + nation * F.lit(0.4) + (key % 10) * F.lit(0.0005)).alias("longitude"),
        (20 + nation * F.lit(0.3) + (key % 7) * F.lit(0.0005)).alias("latitude"),
        F.when(key % 11 != 0, F.floor(F.abs("s_acctbal") / 100).cast("double")).alias("price"),
        with_prefix("m", nation).alias("mall_id"),
    )


def _scans(lineitem: DataFrame) -> DataFrame:
    """One scan per order: its text, and the shops of its three strongest hits.

    Collecting gains nothing from a partial step before the shuffle, so lines
    are placed by order first, as they are, and made into texts there.
    """
    signal = F.col("l_quantity").cast("int") - 100
    token = F.concat_ws(
        "|",
        F.concat(F.lit("b_"), F.col("l_suppkey") * 100 + F.col("l_partkey") % 100),
        signal.cast("string"),
        (F.col("l_linestatus") == "O").cast("string"),
    )
    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    raw = ["l_orderkey", *place, "l_quantity", "l_linestatus"]
    lines = lineitem.select(raw).repartition("l_orderkey").select(
        F.col("l_orderkey").alias("row_id"),
        F.struct(*place, token.alias("token"), (-signal).alias("weakness")).alias("line"),
    )
    collected = lines.groupBy("row_id").agg(F.sort_array(F.collect_list("line")).alias("in_order"))
    # Lines are in order already, so their number stands for their place.
    by_strength = F.sort_array(
        F.transform("in_order", lambda x, i: F.struct(x["weakness"].alias("weakness"), i.alias("i"), x["l_suppkey"].alias("l_suppkey")))
    )
    return collected.select(
        "row_id",
        F.array_join(F.col("in_order")["token"], ";").alias("wifi_infos"),
        F.slice(by_strength, 1, 3)["l_suppkey"].alias("top_suppkeys"),
    )


def _rows(orders: DataFrame, scans: DataFrame, shops: DataFrame) -> DataFrame:
    key = F.col("row_id")
    rows = (
        orders.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_orderdate")
        .repartition("row_id")
        .join(scans, "row_id", "left")
        .withColumn("shop_id", with_prefix("s", F.get("top_suppkeys", F.lit(0))))
    )
    places = shops.select("shop_id", "mall_id", "longitude", "latitude")
    return spread_join(rows, places, "shop_id", "left").select(
        "row_id",
        "o_orderstatus",
        with_prefix("u", "o_custkey").alias("user_id"),
        "shop_id",
        F.coalesce("mall_id", F.lit("m_0")).alias("mall_id"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=(key * 37 % 1440).cast("int"))).alias("time_stamp"),
        (F.coalesce("longitude", F.lit(110.0)) + (key % 21 - 10) * F.lit(0.0002)).alias("longitude"),
        (F.coalesce("latitude", F.lit(20.0)) + (key % 17 - 8) * F.lit(0.0002)).alias("latitude"),
        "wifi_infos",
        "top_suppkeys",
    )


def _prior(rows: DataFrame) -> DataFrame:
    """The shops of the second and third strongest hits, as if guessed by an earlier model."""
    top = F.col("top_suppkeys")
    guess = rows.select("row_id", F.get(top, F.lit(0)).alias("truth"), F.posexplode(F.slice(top, 2, 2)))
    return guess.select(
        "row_id",
        with_prefix("s", "col").alias("shop_id"),
        (F.col("col") == F.col("truth")).cast("int").alias("label"),
        F.col("pos").alias("shop_index"),
    )
