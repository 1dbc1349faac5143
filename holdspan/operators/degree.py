"""Day means, degree days and room temperatures over calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions import calendar as C
from holdspan.options import HeatingOptions
from holdspan.operators.intervals import day_slices

SITE = ("site_id",)
PERIOD = ("grain", "year", "part")
ROOM = ("floor_pos", "room_pos")


def daily_means(samples: DataFrame, tz: str | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Time-weighted mean, covered seconds and length of every local day with data."""
    value = F.col("value")
    usable = samples.filter(~F.isnan(value) & (F.abs(value) < float("inf")))
    return (
        day_slices(usable, tz)
        .groupBy(*keys, "day")
        .agg(
            F.sum(value * F.col("seconds")).alias("_weighted"),
            F.sum("seconds").alias("covered_seconds"),
        )
        .filter("covered_seconds > 0")
        .select(
            *keys,
            "day",
            (F.col("_weighted") / F.col("covered_seconds")).alias("mean"),
            "covered_seconds",
            C.day_length(F.col("day"), tz).alias("day_seconds"),
        )
    )


def is_counted(min_coverage: float) -> Column:
    """Whether a day is covered enough to count."""
    return F.col("covered_seconds") / F.col("day_seconds") >= min_coverage


def counted_days(days: DataFrame, min_coverage: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """Days that count and those too short, and the first and last day touched."""
    counted = is_counted(min_coverage)
    return days.groupBy(*keys).agg(
        F.count_if(counted).alias("counted_days"),
        F.count_if(~counted).alias("short_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def with_sensor_count(rooms: DataFrame) -> DataFrame:
    """The rooms dimension with how many sensors each room has."""
    room = Window.partitionBy("site_id", *ROOM)
    return rooms.withColumn("sensors", F.count(F.lit(1)).over(room))


def group_days(days: DataFrame, rooms: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """A room's days: the plain mean of its sensors that covered the day.

    ``days`` are per ``(site_id, sensor)``. A room with one sensor passes through unfiltered; one
    with several takes only covered days, keeps the largest coverage, and marks days on which some
    sensor fell short as ``partial``.
    """
    # Days come out of an explode, which size estimates do not see: they are never broadcast.
    joined = days.hint("merge").join(
        with_sensor_count(rooms).select("site_id", *ROOM, "sensor", "sensors"), ["site_id", "sensor"]
    )
    used = joined.filter((F.col("sensors") == 1) | is_counted(min_coverage))
    return (
        used.groupBy("site_id", *ROOM, "day")
        .agg(
            F.avg("mean").alias("mean"),
            F.max("covered_seconds").alias("covered_seconds"),
            F.first("day_seconds").alias("day_seconds"),
            F.count(F.lit(1)).alias("_used"),
            F.first("sensors").alias("_sensors"),
        )
        .withColumn("partial", (F.col("_sensors") > 1) & (F.col("_used") < F.col("_sensors")))
        .drop("_used", "_sensors")
    )


def partial_days(room_days: DataFrame) -> DataFrame:
    """Per room, on how many days only some of its sensors covered the day; rooms without such days left out."""
    return room_days.filter("partial").groupBy("site_id", *ROOM).agg(F.count(F.lit(1)).alias("partial_days"))


def heating_degrees(mean: Column, base: float = 15.0) -> Column:
    """Degrees below the heating base."""
    return F.greatest(F.lit(base) - mean, F.lit(0.0))


def cooling_degrees(mean: Column, base: float = 21.0) -> Column:
    """Degrees above the cooling base."""
    return F.greatest(mean - F.lit(base), F.lit(0.0))


def degree_days(days: DataFrame, options: HeatingOptions = HeatingOptions()) -> DataFrame:
    """Day means with heating and cooling degree days."""
    return days.withColumn("hdd", heating_degrees(F.col("mean"), options.heating_base)).withColumn(
        "cdd", cooling_degrees(F.col("mean"), options.cooling_base)
    )


def _by_period(rows: DataFrame, grains: Sequence[str]) -> DataFrame:
    spread = rows.withColumn("_period", F.explode(C.periods_of(F.col("day"), tuple(grains))))
    return spread.select("*", "_period.*").drop("_period")


def period_summary(
    days: DataFrame,
    options: HeatingOptions = HeatingOptions(),
    grains: Sequence[str] = ("month", "year", "record"),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Counted and possible days, mean outside and degree days per period.

    Possible days run from the first to the last day touched. A period appears if it has a counted
    day; the whole record always does.
    """
    span = days.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    spine = span.select(*keys, F.explode(F.sequence("_first", "_last")).alias("day"))
    counted = degree_days(days.filter(is_counted(options.min_coverage)), options)
    filled = spine.hint("merge").join(counted.select(*keys, "day", "mean", "hdd", "cdd"), [*keys, "day"], "left")
    return (
        _by_period(filled, grains)
        .groupBy(*keys, *PERIOD)
        .agg(
            F.count("mean").alias("days"),
            F.count(F.lit(1)).alias("possible_days"),
            F.avg("mean").alias("outside"),
            F.coalesce(F.sum("hdd"), F.lit(0.0)).alias("hdd"),
            F.coalesce(F.sum("cdd"), F.lit(0.0)).alias("cdd"),
        )
        .filter("days > 0 or grain = 'record'")
    )


def room_means(
    room_days: DataFrame,
    outside_days: DataFrame,
    min_coverage: float = 0.9,
    grains: Sequence[str] = ("month", "year", "record"),
) -> DataFrame:
    """A room's mean per period, over its counted days that the outside counted too."""
    outside = outside_days.filter(is_counted(min_coverage)).select("site_id", "day")
    both = room_days.filter(is_counted(min_coverage)).hint("merge").join(outside, ["site_id", "day"])
    return (
        _by_period(both.select("site_id", *ROOM, "day", "mean"), grains)
        .groupBy("site_id", *PERIOD, *ROOM)
        .agg(F.avg("mean").alias("mean"), F.count(F.lit(1)).alias("days"))
    )


def floor_means(rooms_by_period: DataFrame) -> DataFrame:
    """The plain mean of a floor's room means; every room counts alike."""
    return rooms_by_period.groupBy("site_id", *PERIOD, "floor_pos").agg(F.avg("mean").alias("mean"))


def coldest_period(
    periods: DataFrame, grain: str = "month", keys: Sequence[str] = KEYS
) -> DataFrame:
    """The period with the most heating degree days, if any has some; ties to the later one."""
    order = Window.partitionBy(*keys).orderBy(F.desc("hdd"), F.desc("year"), F.desc("part"))
    return (
        periods.filter((F.col("grain") == grain) & (F.col("hdd") > 0))
        .withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .drop("_rank")
    )


def days_mark(days: Column, possible: Column) -> Column:
    """``31 days``, or ``28 of 31 days`` for a period with days missing."""
    return F.when(days >= possible, F.format_string("%d days", days)).otherwise(
        F.format_string("%d of %d days", days, possible)
    )


def period_report(periods: DataFrame, floors: DataFrame, floor_count: int) -> DataFrame:
    """The period table: label, days mark, weather, and one column per floor position."""
    keys = ["site_id", *PERIOD]
    # The record has no year or part; a join needs values that compare equal.
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_y", F.coalesce("year", F.lit(0))).withColumn("_p", F.coalesce("part", F.lit(0)))

    wide = (
        keyed(floors)
        .groupBy("site_id", "grain", "_y", "_p")
        .pivot("floor_pos", list(range(floor_count)))
        .agg(F.first("mean"))
        .withColumnsRenamed({str(i): f"floor_{i}" for i in range(floor_count)})
    )
    return (
        keyed(periods)
        .join(wide, ["site_id", "grain", "_y", "_p"], "left")
        .select(
            *keys,
            C.period_label(F.col("grain"), F.col("year"), F.col("part")).alias("label"),
            days_mark(F.col("days"), F.col("possible_days")).alias("days"),
            "outside",
            "hdd",
            "cdd",
            *[f"floor_{i}" for i in range(floor_count)],
        )
    )
