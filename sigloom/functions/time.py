"""Dates and delays as columns; now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """RFC 3339, else RFC 2822, else the first ten characters as a date."""
    t = F.trim(text)
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(t)),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm xx")),
        F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")),
    )


def shown(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def age_minutes(at: Column, now: Column) -> Column:
    """Whole minutes from at to now, none below zero."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)).cast("long")


def retry_minutes(interval: Column, failures: Column, temporary: Column, retry_after_seconds: Column) -> Column:
    """How long to wait after a failure: what the server says, a minute at least; else twice as long each time, a day at most."""
    base = F.when(temporary, F.lit(5)).otherwise(F.greatest(interval, F.lit(5)))
    steps = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(10))
    return F.when(retry_after_seconds.isNotNull(), F.greatest(retry_after_seconds, F.lit(60)) / F.lit(60.0)).otherwise(F.least(F.lit(1440.0), base * F.pow(F.lit(2.0), steps)))
