"""Calendar parts of a time stamp."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def calendar_columns(time_stamp: Column | str) -> dict[str, Column]:
    """Day of month, hour, minute and ISO weekday (1 = Monday)."""
    return {
        "transaction_day": F.dayofmonth(time_stamp),
        "transaction_hour": F.hour(time_stamp),
        "transaction_minute": F.minute(time_stamp),
        "transaction_isoweekday": F.weekday(time_stamp) + 1,
    }
