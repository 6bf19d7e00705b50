"""Times without a zone, read as UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: Column) -> Column:
    """The instant of a zoneless time in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp")


def zoneless(at: Column) -> Column:
    """The zoneless UTC time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def micros(at: Column) -> Column:
    return F.unix_micros(instant(at))
