"""Crawl identifiers (``CC-MAIN-<year>-<week>``) as dates, years and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DUMP = r"^CC-MAIN-\d{4}-\d{2,4}$"


def year_of(dump: Column) -> Column:
    return F.when(dump.rlike(DUMP), F.substring(dump, 9, 4).cast("int"))


def monday_of(dump: Column) -> Column:
    """Monday of the ISO week that a crawl is named for; null for other names."""
    week = F.least(F.greatest(F.substring(dump, 14, 2).cast("int"), F.lit(1)), F.lit(53))
    first = F.date_trunc("week", F.make_date(F.substring(dump, 9, 4).cast("int"), F.lit(1), F.lit(4))).cast("date")
    return F.when(dump.rlike(DUMP), F.date_add(first, (week - 1) * 7))


def in_range(dump: Column, since: int | None = None, first: str | None = None, last: str | None = None) -> Column:
    """A well-formed crawl from the year on, and between two names in text order."""
    ok = F.coalesce(dump.rlike(DUMP), F.lit(False))
    if since is not None:
        ok = ok & (F.substring(dump, 9, 4).cast("int") >= since)
    if first is not None:
        ok = ok & (dump >= first)
    if last is not None:
        ok = ok & (dump <= last)
    return ok


def in_dates(dump: Column, first: str, last: str) -> Column:
    """Whether a crawl's Monday lies between two days; names that can't be read are kept."""
    day = monday_of(dump)
    return F.coalesce((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")), F.lit(True))
