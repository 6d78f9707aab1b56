"""Date and time expressions: clocks, month shifts, period labels, calendars."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The label formats of the reports.
MONTH_LABEL = "yyyy MM'월'"
YEAR_LABEL = "yyyy'년'"
MONTH_KEY = "yyyyMM"
MONTH_KEY_LABEL = "yyyy'년'MM'월'"

SUMMARY_TYPES = ("month", "quarter", "year")


def ntz(value) -> Column:
    """A clock value (datetime, date, text or column) as a timestamp without time zone."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (datetime, date)):
        value = value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def months_before(ts, months: int) -> Column:
    """Shift back by whole months; a day the month does not have becomes its last day."""
    return ntz(ts) - F.make_ym_interval(F.lit(0), F.lit(months))


def days_before(ts, days: int) -> Column:
    return ntz(ts) - F.make_dt_interval(F.lit(days))


def wall_minutes(ts: Column) -> Column:
    """Minutes since 1970 by the fields of the timestamp: no time zone or clock change comes in."""
    return F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def wall_seconds(ts: Column) -> Column:
    return wall_minutes(ts) * 60 + F.second(ts)


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 by the fields of the timestamp."""
    seconds = F.extract(F.lit("SECOND"), ts)  # with its fraction
    return wall_minutes(ts) * 60_000_000 + (seconds * 1_000_000).cast("long")


def whole_days(end: Column, start: Column) -> Column:
    """Number of midnights between two moments; negative if `end` is earlier."""
    return F.datediff(end, start)


def period_label(ts: Column, summary_type: str) -> Column:
    """`2024 03월`, `2024 1Q` or `2024년`."""
    if summary_type == "month":
        return F.date_format(ts, MONTH_LABEL)
    if summary_type == "quarter":
        return F.concat(F.date_format(ts, "yyyy "), F.quarter(ts).cast("string"), F.lit("Q"))
    if summary_type == "year":
        return F.date_format(ts, YEAR_LABEL)
    raise ValueError(f"summary_type must be one of {SUMMARY_TYPES}, not {summary_type!r}")


def month_key(ts: Column) -> Column:
    """`YYYYMM`, the key of the monthly counters."""
    return F.date_format(ts, MONTH_KEY)


def month_key_label(key: Column) -> Column:
    """`202401` as `2024년01월`."""
    return F.date_format(F.to_date(key, MONTH_KEY), MONTH_KEY_LABEL)


def calendar(spark: SparkSession, start: Column, end: Column, summary_type: str) -> DataFrame:
    """The distinct period labels met when stepping day by day from `start` while <= `end`.

    The steps keep the time of day of `start`. One row per day of the range, so a century is
    36,525 rows whatever the size of the data.
    """
    days = F.when(start <= end, F.sequence(start, end, F.make_dt_interval(F.lit(1))))
    return (
        spark.range(1)
        .select(F.explode(days).alias("day"))
        .select(period_label(F.col("day"), summary_type).alias("period"))
        .distinct()
    )
