"""Dense codes in ascending order of value, without gathering the values anywhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from aislefix.operators.spread import spread_join
from aislefix.settings import PAD, SLOTS
from aislefix.sources.tables import materialize

_BITS = 22


def distinct_values(values: DataFrame) -> DataFrame:
    return values.select("name", "value").where(F.col("value").isNotNull()).distinct()


def dense_codes(distinct: DataFrame, bits: int = _BITS) -> DataFrame:
    """Distinct (name, value) -> (name, value, code): the value's rank among the name's values, from 0.

    ``distinct`` is read three times: give it a stored table where it is costly.

    A bigint is cut into its low, middle and high bits. Ranks are taken inside
    a low range, range sizes are summed inside a middle range, and those inside
    the name, so no window ever holds more than 2**22 rows whatever the data.
    """
    distinct = distinct.withColumns({"low": F.shiftright("value", bits), "high": F.shiftright("value", 2 * bits)})
    ranked = distinct.withColumn(
        "rank", F.row_number().over(Window.partitionBy("name", "low").orderBy("value")) - F.lit(1)
    )
    lows = distinct.groupBy("name", "high", "low").agg(F.count("*").alias("n"))
    highs = lows.groupBy("name", "high").agg(F.sum("n").alias("n"))

    def before(*group: str, order: str):
        running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("n").over(running) - F.col("n")

    lows = lows.withColumn("low_start", before("name", "high", order="low"))
    highs = highs.select("name", "high", before("name", order="high").alias("high_start"))
    starts = lows.join(highs, ["name", "high"]).select(
        "name", "low", (F.col("low_start") + F.col("high_start")).alias("start")
    )
    return ranked.join(starts, ["name", "low"]).select(
        "name", "value", (F.col("start") + F.col("rank")).alias("code")
    )


def row_numbers(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a dense number from 0 in ascending order of the unique bigint ``key``."""
    codes = dense_codes(distinct_values(rows.select(F.lit(key).alias("name"), F.col(key).alias("value"))))
    return rows.join(codes.select(F.col("value").alias(key), F.col("code").alias("row_number")), key)


def encoded_columns(slots: int = SLOTS) -> list[str]:
    return ["mall_no", *(f"wifi{k}_bssid" for k in range(1, slots + 1))]


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in columns))
    found = rows.select("row_id", F.explode(cells).alias("cell")).select("row_id", "cell.name", "cell.value")
    value = F.col("value")
    refused = F.raise_error(F.concat(F.lit("negative id: "), value.cast("string"))).cast("bigint")
    return found.withColumn("value", F.when((value < 0) & (value != PAD), refused).otherwise(value))


def ordinal_codes(
    rows: DataFrame, columns: Sequence[str], hand_off: Callable[[DataFrame, str], DataFrame] = lambda df, _: df
) -> DataFrame:
    """Codes of every column, fitted on the given rows (labelled and query rows together).

    ``hand_off`` stores a frame and reads it back; the distinct values go through it once.
    """
    return dense_codes(hand_off(distinct_values(_long(rows, columns)), "values"))


def ordinal_encode(rows: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``<column>_code`` for each column, through one join for all columns.

    Negative ids are refused, so where padding occurs it is the smallest value and
    its code is 0: the most frequent value by far needs no join.
    """
    cells = _long(rows, columns).where(F.col("value") != PAD)
    found = spread_join(cells, codes, ["name", "value"])
    by_row = found.groupBy("row_id").agg(
        *(F.max(F.when(F.col("name") == name, F.col("code"))).alias(f"{name}_code") for name in columns)
    )
    filled = {
        f"{name}_code": F.when(F.col(name) == PAD, F.lit(0)).otherwise(F.col(f"{name}_code")) for name in columns
    }
    return rows.join(by_row, "row_id", "left").withColumns(filled)


def numbered(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows without a key, numbered from 0 in the order of all their columns; equal rows keep their own numbers.

    Rows are dealt out in ranges of all columns and numbered inside each range;
    a range begins where the ones before it end. The place of a row depends on how they
    were dealt out: store the result before it is read twice.
    """
    part = F.spark_partition_id()
    dealt = rows.repartitionByRange(*rows.columns).withColumn("_part", part)
    return number_ranges(materialize(dealt, "numbered"), "_part", rows.columns, name)


def number_ranges(dealt: DataFrame, part: str, columns: Sequence[str], name: str) -> DataFrame:
    """Number rows from 0 by range, and inside each range by ``columns``.

    A row meets the start of its range by a join on the range's number, so that its cost does not depend on how many
    ranges there are. ``dealt`` is read twice.
    """
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_size"))
    # One row a range: starts are sums over blocks of ranges and inside a block, so no task gets them all.
    blocks = sizes.withColumn("_block", F.shiftright(part, 10))
    totals = blocks.groupBy("_block").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside_block = Window.partitionBy("_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    begins = totals.select("_block", F.coalesce(F.sum("_total").over(before), none).alias("_begin"))
    starts = blocks.withColumn("_ahead", F.coalesce(F.sum("_size").over(inside_block), none)).join(begins, "_block")
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*columns)) - F.lit(1)
    ranked = dealt.withColumn("_inside", inside)
    found = ranked.join(starts.select(part, (F.col("_begin") + F.col("_ahead")).alias("_start")), part)
    return found.select((F.col("_start") + F.col("_inside")).alias(name), *columns)
