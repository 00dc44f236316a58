"""Dates of documents and reports: what isn't one gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def plain_date(c: Column) -> Column:
    """yyyy-m-d as a date; other forms, and days that don't exist, are null."""
    t = blank(c)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t.try_cast("date"))


def iso_time(c: Column) -> Column:
    """ISO date, or date and time, without a zone; others are null."""
    t = blank(c)
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$"
    return F.when(t.rlike(form), t.try_cast("timestamp_ntz"))


def fresh(at: Column, now: Column, seconds: int = 86_400) -> Column:
    """Is what was fetched ``at`` still good: younger than ``seconds``; unknown times are not."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(age < seconds * 1_000_000, F.lit(False))
