"""Scalar date and time expressions (all in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col

MICROSECOND = "INTERVAL '0.000001' SECOND"


def to_utc(value: Column | str, zone: str = "UTC") -> Column:
    """Instant of a wall-clock time read in ``zone`` (a naive time is UTC)."""
    return F.to_utc_timestamp(as_col(value), zone)


def parse_datetime(value: Column | str) -> Column:
    """ISO text with Z or an offset to an instant; null when it cannot be read."""
    return F.try_to_timestamp(F.trim(as_col(value)))


def parse_date(value: Column | str) -> Column:
    return F.trim(as_col(value)).try_cast("date")


def start_of_day(value: Column | str) -> Column:
    return F.date_trunc("day", as_col(value))


def end_of_day(value: Column | str) -> Column:
    return start_of_day(value) + F.expr("INTERVAL 1 DAY") - F.expr(MICROSECOND)


def start_of_hour(value: Column | str) -> Column:
    return F.date_trunc("hour", as_col(value))


def end_of_hour(value: Column | str) -> Column:
    return start_of_hour(value) + F.expr("INTERVAL 1 HOUR") - F.expr(MICROSECOND)


def add_seconds(value: Column | str, seconds: Column | float) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return as_col(value) + F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def add_minutes(value: Column | str, minutes: Column | int) -> Column:
    amount = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return as_col(value) + F.make_dt_interval(mins=amount)


def add_hours(value: Column | str, hours: Column | int) -> Column:
    amount = hours if isinstance(hours, Column) else F.lit(hours)
    return as_col(value) + F.make_dt_interval(hours=amount)


def add_days(value: Column | str, days: Column | int) -> Column:
    amount = days if isinstance(days, Column) else F.lit(days)
    return as_col(value) + F.make_dt_interval(days=amount)


def difference_seconds(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in seconds with the microseconds kept."""
    return (F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))) / F.lit(1_000_000.0)


def is_late(event_time: Column | str, ingestion_time: Column | str) -> Column:
    return as_col(ingestion_time) > as_col(event_time)


def partition_values(value: Column | str) -> dict[str, Column]:
    """Year, month, day and hour columns of an instant."""
    moment = as_col(value)
    return {
        "year": F.year(moment),
        "month": F.month(moment),
        "day": F.dayofmonth(moment),
        "hour": F.hour(moment),
    }


def partition_path(base: str, value: Column | str, include_hour: bool = False) -> Column:
    """``base/year=YYYY/month=MM/day=DD[/hour=HH]`` as text."""
    pattern = "'year='yyyy'/month='MM'/day='dd" + ("'/hour='HH" if include_hour else "")
    root = base.rstrip("/")
    return F.concat(F.lit(f"{root}/"), F.date_format(as_col(value), pattern))


def partition_spec(value: Column | str, include_hour: bool = False) -> Column:
    """``year=Y, month=M, day=D[, hour=H]`` as text, without zero padding."""
    parts = partition_values(value)
    names = ["year", "month", "day"] + (["hour"] if include_hour else [])
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), parts[n]) for n in names])


def sink_partitions(value: Column | str) -> dict[str, Column]:
    """Zero-padded partition columns of the event archive (fixed column names)."""
    moment = as_col(value)
    return {
        "ano": F.date_format(moment, "yyyy"),
        "mes": F.date_format(moment, "MM"),
        "dia": F.date_format(moment, "dd"),
        "hora": F.date_format(moment, "HH"),
    }


def floor_timestamp(value: Column | str, interval_seconds: int) -> Column:
    """Floor to a multiple of the interval counted from the epoch."""
    if interval_seconds <= 0:
        raise ValueError("interval_seconds must be positive")
    step = F.lit(interval_seconds)
    seconds = F.unix_seconds(as_col(value))
    return F.timestamp_seconds(seconds - F.pmod(seconds, step))
