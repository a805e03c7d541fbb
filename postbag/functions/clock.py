"""Date and time functions.

Times are wall-clock UTC in ``TIMESTAMP_NTZ``. Nothing here reads the session zone.
"""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag import schema as S

_MICROS = 1_000_000


def to_zone(ts: Column, zone: str, from_zone: str = "UTC") -> Column:
    """Wall-clock time of one zone to that of another."""
    return F.convert_timezone(F.lit(from_zone), F.lit(zone), ts)


def day_of(ts: Column, zone: str = "UTC") -> Column:
    """Calendar day in ``zone`` of a UTC time."""
    return F.to_date(ts if zone == "UTC" else to_zone(ts, zone))


def day_bounds(day: dt.date, zone: str = "UTC") -> tuple[Column, Column]:
    """First instant of a calendar day of ``zone`` and of the next one, in UTC.

    Both fold to constants, so that a comparison with them reaches the file scan.
    """

    def midnight(d: dt.date) -> Column:
        local = F.lit(d.isoformat()).cast("timestamp_ntz")
        return local if zone == "UTC" else to_zone(local, "UTC", zone)

    return midnight(day), midnight(day + dt.timedelta(days=1))


def micros_of(ts: Column) -> Column:
    """Microseconds from 1970-01-01 00:00:00 on the same wall clock."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * _MICROS + (F.date_part(F.lit("SECOND"), ts) * _MICROS).cast("bigint")


def utc_instant(ts: Column) -> Column:
    """UTC wall-clock time as the instant it names (streams want this type)."""
    return F.timestamp_micros(micros_of(ts))


def seconds_until(start: Column, end: Column) -> Column:
    return (micros_of(end) - micros_of(start)) / F.lit(float(_MICROS))


def _window_on(local_day: Column, zone: str, hour: int) -> Column:
    local = local_day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    return to_zone(local, "UTC", zone)


def next_window_start(now: Column, zone: str = S.SEND_ZONE, hour: int = S.SEND_HOUR) -> Column:
    """The next time the clock in ``zone`` shows ``hour``; at or past it, tomorrow's."""
    local = to_zone(now, zone)
    wait = F.when(F.hour(local) >= hour, 1).otherwise(0)
    return _window_on(F.date_add(F.to_date(local), wait), zone, hour)


def send_after(
    now: Column, send_day: Column, zone: str = S.SEND_ZONE, hour: int = S.SEND_HOUR
) -> Column:
    """When day ``send_day`` of a plan made at ``now`` opens: at once, or at ``hour`` of that day."""
    later = _window_on(F.date_add(F.to_date(to_zone(now, zone)), send_day.cast("int")), zone, hour)
    return F.when(send_day == 0, now).otherwise(later)
