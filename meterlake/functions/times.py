"""Times as text in UTC, and JSON fields."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.cast("long")), ISO)


def iso_seconds(seconds: Column) -> Column:
    return iso_millis(F.floor(seconds * 1000))


def millis_of(text: Column) -> Column:
    """Milliseconds of an ISO time; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times in seconds, at least 0; null if either is null."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), F.floor((end - start) * 1000 + 0.5).cast("double")))


def stamp(now: datetime) -> str:
    return now.strftime("%Y-%m-%d %H:%M:%S")


def cutoff(now: datetime, days: float | None) -> str | None:
    """The text from which records of the last ``days`` days begin; null for no bound.

    It is compared as text with ISO times, so every record of the day of the bound is in.
    """
    if not days:
        return None
    if math.isnan(days) or math.isinf(days) or days < 0:
        raise ValueError(f"days must be a number of at least 0, not {days}")
    return stamp(now - timedelta(days=math.floor(days)))


def json_of(ignore_nulls: bool, **fields: Column) -> Column:
    """A JSON object of the fields, without those that are null or with them as null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": str(ignore_nulls).lower()})
