"""Time expressions. Every `as_of` is a value the caller states."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(moment: datetime | str) -> Column:
    """A literal instant; a naive or textual moment is read as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    micros = int(round(moment.timestamp() * 1_000_000))
    return F.timestamp_micros(F.lit(micros))


def as_instant(value: Column) -> Column:
    """A zone-less timestamp read in the session zone, which callers pin to UTC."""
    return value.cast("timestamp")


def age_minutes(latest: Column, as_of: datetime | str) -> Column:
    """Minutes from `latest` to `as_of`, counted on whole milliseconds."""
    elapsed = F.unix_millis(instant(as_of)) - F.unix_millis(as_instant(latest))
    return elapsed / F.lit(60_000.0)
