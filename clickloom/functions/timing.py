"""Event time. Epoch seconds order the clicks; the wall clock of a named zone gives day, hour and minute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# bins per hour -> minutes per bin
BINS = {2: 30, 4: 15, 6: 10, 12: 5}


def wall_clock(epoch: str | Column, zone: str = "UTC") -> Column:
    """Local time of ``zone`` as a zone-less timestamp, whatever the session's own zone is."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch)
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def time_parts(epoch: str = "context_timestamp", zone: str = "UTC", first_day: str = "2024-01-01") -> dict[str, Column]:
    """``ts``, running day index (0 on ``first_day``), day of month, hour and minute."""
    clock = wall_clock(epoch, zone)
    return {
        "ts": clock,
        "day_idx": F.datediff(clock.cast("date"), F.lit(first_day).cast("date")),
        "day": F.dayofmonth(clock),
        "hour": F.hour(clock),
        "minute": F.minute(clock),
    }


def time_bucket(bins_per_hour: int, hour: str = "hour", minute: str = "minute") -> Column:
    """Time-of-day bin without a day component."""
    return (F.col(hour) * bins_per_hour + F.floor(F.col(minute) / F.lit(BINS[bins_per_hour]))).cast("int")


def time_buckets() -> dict[str, Column]:
    return {f"hour_{bins}": time_bucket(bins) for bins in BINS}


def shift_days(ts: str | Column, days: int = 1) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.make_dt_interval(F.lit(days))


def whole_days(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(DAY)).cast("bigint")


def day_seconds(seconds: Column) -> Column:
    """Seconds left after taking off whole days, in [0, 86400)."""
    return F.pmod(seconds, F.lit(DAY)).cast("bigint")
