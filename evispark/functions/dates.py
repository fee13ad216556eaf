"""Partial dates and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latest_day(value: Column) -> Column:
    """The last day that ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` covers; null for anything else."""
    year = F.when(value.rlike(r"^\d{4}$"), F.try_to_date(F.concat(value, F.lit("-12-31")), "yyyy-MM-dd"))
    month = F.when(value.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd")))
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(year, month, day)


def wholly_before(value: Column, cutoff: Column) -> Column:
    """Whether all days that a partial date covers lie before the cutoff; null for invalid dates."""
    return latest_day(value) < cutoff


def year(value: Column) -> Column:
    """The first year of this century that stands alone; null if there is none (``20210304`` has none)."""
    return F.nullif(F.regexp_extract(value, r"(?U)\b(20\d{2})\b", 1), F.lit("")).cast("int")


def retry_delay(header: Column, attempt: Column, now: Column) -> Column:
    """Seconds to wait: the header's seconds, or the time until its date, or ``min(2**attempt, 30)``; never below 0."""
    seconds = header.try_cast("double")
    until = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_micros(until) - F.unix_micros(now)) / 1e6)
    return F.coalesce(F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0))), F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0)))
