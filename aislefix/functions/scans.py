"""WiFi scans: ``b_<id>|<signal>|true;b_<id>|<signal>|false;...``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aislefix.functions.ids import id_number
from aislefix.settings import PAD, SLOTS


def _tokens(scan: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(scan, F.lit("")), ";"), lambda token: token != "")


def scan_size(scan: Column | str) -> Column:
    """Number of hits in a scan; a missing scan has none."""
    return F.size(_tokens(scan))


def ranked_hits(scan: Column | str) -> Column:
    """Scan text -> hits, strongest first; equal signals keep the scan's order.

    A hit that does not have three fields, or whose last is neither true nor
    false, fails the job. The element's first two fields are the negated signal and the place in the
    scan, so the plain ascending array sort is already the stable order.
    """

    def hit(token: Column, place: Column) -> Column:
        signal = F.substring_index(F.substring_index(token, "|", 2), "|", -1).cast("int")
        flag = F.substring_index(token, "|", -1)
        whole = (F.length(token) - F.length(F.replace(token, F.lit("|"), F.lit(""))) == 2) & flag.isin("true", "false")
        wrong = F.raise_error(F.concat(F.lit("not a hit: "), token)).cast("int")
        return F.struct(
            (-signal).alias("weakness"),
            (place + 1).alias("pos"),
            id_number(F.substring_index(token, "|", 1)).alias("wifi_bssid"),
            F.when(whole, (flag == "true").cast("int")).otherwise(wrong).alias("wifi_flag"),
        )

    return F.sort_array(F.transform(_tokens(scan), hit))


def wrong_hits(scan: Column | str) -> Column:
    """The tokens of a scan that are not hits."""
    return F.filter(_tokens(scan), lambda token: ~token.rlike(r"^(?:[^|]*_)?-?[0-9]+\|-?[0-9]+\|(?:true|false)$"))


def with_hits(rows: DataFrame) -> DataFrame:
    """Rows with the parsed scan as ``hits`` in place of its text: stored so, each later step reads only the fields it needs."""
    return rows.withColumn("hits", ranked_hits("wifi_infos")).drop("wifi_infos")


def hits_of(rows: DataFrame) -> Column:
    """The hits of scans, parsed now unless they are stored parsed."""
    return F.col("hits") if "hits" in rows.columns else ranked_hits("wifi_infos")


def slot_columns(ranked: str, slots: int = SLOTS) -> dict[str, Column]:
    """The strongest hits of a ranked scan as flat columns, padded to ``slots``."""
    columns: dict[str, Column] = {}
    for k in range(1, slots + 1):
        hit = F.get(F.col(ranked), F.lit(k - 1))
        columns[f"wifi{k}_bssid"] = F.coalesce(hit["wifi_bssid"], F.lit(PAD).cast("bigint"))
        columns[f"wifi{k}_signal"] = F.coalesce(-hit["weakness"], F.lit(PAD))
        columns[f"wifi{k}_flag"] = F.coalesce(hit["wifi_flag"], F.lit(0))
    return columns
