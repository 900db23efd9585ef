"""Epoch arithmetic on bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a larger timestamp is in milliseconds.
MILLISECONDS_ABOVE = 100_000_000_000


def integer_div(value: Column, by: int) -> Column:
    """Integer division that truncates towards zero, as bigint."""
    return F.call_function("div", value.cast("bigint"), F.lit(by).cast("bigint"))


def to_seconds(ts: Column) -> Column:
    """Milliseconds brought to seconds, once; other values as they are."""
    return F.when(ts > MILLISECONDS_ABOVE, integer_div(ts, 1000)).otherwise(ts)


def time_bucket(ts: Column, hours: int) -> Column:
    """Number of the tumbling window of ``hours`` hours that ``ts`` seconds fall in."""
    return integer_div(ts, hours * 3600)
