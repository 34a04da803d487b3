"""Time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def legacy_time(parts: Column) -> Column:
    """year, day of the year, hour, minute, second, nanosecond, offset hours, minutes, seconds."""
    at = lambda i: F.get(parts, F.lit(i))
    start = F.make_timestamp(at(0).cast("int"), F.lit(1), F.lit(1), at(2).cast("int"), at(3).cast("int"), (at(4) + at(5) / F.lit(1e9)).cast("decimal(16,6)"))
    zero = F.lit(0)
    return start + F.make_interval(zero, zero, zero, (at(1) - 1).cast("int")) - F.make_interval(zero, zero, zero, zero, at(6).cast("int"), at(7).cast("int"), at(8).cast("decimal(16,6)"))


def expires_at(created: Column, hours: int) -> Column:
    zero = F.lit(0)
    return created + F.make_interval(zero, zero, zero, zero, F.lit(hours))
