"""Local calendars over epoch seconds.

A local wall clock is carried as *local seconds*: the epoch seconds plus the zone's offset. Every
further part is integer arithmetic on them, so results do not depend on the session's zone.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HOUR = 3_600
EPOCH = "1970-01-01"

# Month names as labels show them.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def floor_to(ts: Column, width: int) -> Column:
    """``ts`` rounded down to a multiple of ``width``."""
    return ts - F.pmod(ts, F.lit(width))


def local_seconds(ts: Column, tz: str | Column) -> Column:
    """Wall-clock seconds of a UTC instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(ts), tz))


def day_of(local: Column) -> Column:
    """The date of local seconds."""
    return F.date_from_unix_date((floor_to(local, DAY) / DAY).cast("int"))


def hour_of(local: Column) -> Column:
    """The hour of day of local seconds, 0..23."""
    return F.floor(F.pmod(local, F.lit(DAY)) / HOUR).cast("int")


def local_day(ts: Column, tz: str | Column) -> Column:
    """The local date of a UTC instant."""
    return day_of(local_seconds(ts, tz))


def iso_year(day: Column) -> Column:
    """The ISO year: the year of the week's Thursday."""
    return F.year(F.date_add(day, F.lit(3) - F.weekday(day)))


def local_parts(ts: Column, tz: str | Column) -> dict[str, Column]:
    """Every calendar part of a UTC instant."""
    local = local_seconds(ts, tz)
    day = day_of(local)
    return {
        "day": day,
        "hour": hour_of(local),
        "month": F.month(day),
        "iso_week": F.weekofyear(day),
        "iso_year": iso_year(day),
        "year": F.year(day),
    }


def midnight(day: Column, tz: str | Column) -> Column:
    """The UTC second a local date begins at: the earlier of two, 01:00 where midnight is skipped."""
    wall = F.timestamp_seconds(F.unix_date(day).cast("bigint") * DAY)
    return F.unix_seconds(F.to_utc_timestamp(wall, tz))


def day_length(day: Column, tz: str | Column) -> Column:
    """Seconds in a local day; a plain day where either midnight is skipped by the clocks."""
    nxt = F.date_add(day, 1)
    start, end = midnight(day, tz), midnight(nxt, tz)

    def kept(date: Column, at: Column) -> Column:
        return F.pmod(local_seconds(at, tz), F.lit(DAY)) == 0

    whole = kept(day, start) & kept(nxt, end) & (end > start)
    return F.when(whole, end - start).otherwise(F.lit(DAY).cast("bigint"))


def month_start(day: Column) -> Column:
    """The first day of a date's month."""
    return F.trunc(day, "month")


def month_days(month: Column) -> Column:
    """Days in the month that starts at ``month``."""
    return F.dayofmonth(F.last_day(month))


def month_hours(month: Column, tz: str | Column) -> Column:
    """Hours in a local month, clock changes included."""
    return ((midnight(F.add_months(month, 1), tz) - midnight(month, tz)) / HOUR).cast("int")


def facet_of(day: Column, grouping: str) -> Column:
    """The month 1..12 or ISO week 1..53 of a date, years pooled."""
    return F.month(day) if grouping == "month" else F.weekofyear(day)


def facet_count(grouping: str) -> int:
    """How many facets a grouping has."""
    return 12 if grouping == "month" else 53


def half_year(month: Column) -> Column:
    """``summer`` April to September, else ``winter``."""
    return F.when(month.between(4, 9), "summer").otherwise("winter")


def heating_season(day: Column) -> Column:
    """The year in which the July-to-June season of a date starts."""
    return F.year(day) - (F.month(day) < 7).cast("int")


def season_label(start_year: Column) -> Column:
    """``2023/24`` for the season that starts in 2023."""
    text = F.format_string("%d/%02d", start_year, F.pmod(start_year + 1, F.lit(100)))
    return F.when(start_year.isNotNull(), text)


def month_name(month: Column) -> Column:
    """The English name of a month number."""
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), month)


def facet_label(facet: Column, grouping: str) -> Column:
    """``June`` or ``Week 05``."""
    return month_name(facet) if grouping == "month" else F.format_string("Week %02d", facet)


def facet_short_label(facet: Column, grouping: str) -> Column:
    """``Jun`` or ``W05``."""
    if grouping == "month":
        return F.substring(month_name(facet), 1, 3)
    return F.format_string("W%02d", facet)


def period_label(grain: Column, year: Column, part: Column) -> Column:
    """``June 2024``, ``Week 05, 2024``, ``2024`` or ``Whole record``."""
    return (
        F.when(grain == "month", F.concat_ws(" ", month_name(part), year.cast("string")))
        .when(grain == "week", F.format_string("Week %02d, %d", part, year))
        .when(grain == "year", year.cast("string"))
        .otherwise("Whole record")
    )


PERIODS = "array<struct<grain:string,year:int,part:int>>"


def periods_of(day: Column, grains: tuple[str, ...] = ("month", "week", "year", "record")) -> Column:
    """The periods a date belongs to, one struct per grain."""
    none = F.lit(None).cast("int")
    of = {
        "month": (F.year(day), F.month(day)),
        "week": (iso_year(day), F.weekofyear(day)),
        "year": (F.year(day), none),
        "record": (none, none),
    }
    return F.array(
        *[
            F.struct(F.lit(g).alias("grain"), of[g][0].alias("year"), of[g][1].alias("part"))
            for g in grains
        ]
    )


def has_part_hour_shift(tz: str) -> bool:
    """Whether a zone ever moved its clocks by less than an hour (half-hour summer time)."""
    zone = ZoneInfo(tz)
    offsets = [
        datetime(year, month, 1, tzinfo=timezone.utc).astimezone(zone).utcoffset().total_seconds()
        for year in range(1970, 2038)
        for month in range(1, 13)
    ]
    return any((b - a) % HOUR for a, b in zip(offsets, offsets[1:]))


def hour_starts(start: Column, end: Column, tz: str | Column) -> Column:
    """Where the pieces of ``[start, end)`` begin when it is cut at local hours.

    A zone that moves by whole hours keeps its minutes, so the cuts are 3600 s apart. Any other
    zone, or one given per row, is probed on the quarter-hour grid all offsets sit on.
    """
    head = F.array(start)
    if isinstance(tz, str) and not has_part_hour_shift(tz):
        first = start + HOUR - F.pmod(local_seconds(start, tz), F.lit(HOUR))
        tail = F.sequence(first, end - 1, F.lit(HOUR).cast("bigint"))
        return F.when(first >= end, head).otherwise(F.concat(head, tail))
    quarter = HOUR // 4
    first = floor_to(start, quarter) + quarter

    def is_cut(at: Column) -> Column:
        here = local_seconds(at, tz)
        return (F.pmod(here, F.lit(HOUR)) == 0) | (here - local_seconds(at - quarter, tz) != quarter)

    probes = F.sequence(first, end - 1, F.lit(quarter).cast("bigint"))
    return F.when(first >= end, head).otherwise(F.concat(head, F.filter(probes, is_cut)))


def slot_starts(start: Column, end: Column, width: int) -> Column:
    """Where the pieces of ``[start, end)`` begin when it is cut at epoch multiples of ``width``."""
    first = floor_to(start, width) + width
    tail = F.sequence(first, end - 1, F.lit(width).cast("bigint"))
    return F.when(first >= end, F.array(start)).otherwise(F.concat(F.array(start), tail))
