"""Heat loss: heating energy against degree-hours between the house and the outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions import calendar as C
from holdspan.options import HeatingOptions
from holdspan.operators.intervals import slot_slices
from holdspan.operators.meter import by_season_and_all, degree_day_line
from holdspan.operators.regress import fit_line

SITE = ("site_id",)
# Coverage of a month's hours, spread of degree-hours a line needs, the change that
# still counts as none, the shares that name a cause, and the least free heat worth reporting.
MIN_HOUR_COVERAGE = 0.9
MIN_DEGREE_HOUR_SPREAD = 15.0 * 24.0
HELD = 0.03
BUILDING_SHARE = 2.0 / 3.0
BEHAVIOUR_SHARE = 1.0 / 3.0
MIN_FREE_HEAT = 10.0


def hourly_means(
    samples: DataFrame, min_coverage: float = 0.9, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Time-weighted mean of every UTC hour covered enough."""
    value = F.col("value")
    usable = samples.filter(~F.isnan(value) & (F.abs(value) < float("inf")))
    covered = F.sum("seconds")
    return (
        slot_slices(usable, C.HOUR)
        .groupBy(*keys, F.col("slot").alias("hour_ts"))
        .agg((F.sum(value * F.col("seconds")) / covered).alias("mean"), covered.alias("_covered"))
        .filter(F.col("_covered") >= min_coverage * C.HOUR)
        .drop("_covered")
    )


def group_hours(hours: DataFrame, rooms: DataFrame) -> DataFrame:
    """A room's hours: the plain mean of its sensors that have the hour.

    Laid out by (site, hour), which also serves the house mean and its meeting with the outside.
    """
    dim = rooms.select("site_id", "floor_pos", "room_pos", "sensor")
    return (
        hours.join(dim, ["site_id", "sensor"])
        .repartition("site_id", "hour_ts")
        .groupBy("site_id", "floor_pos", "room_pos", "hour_ts")
        .agg(F.avg("mean").alias("mean"))
    )


def house_hours(room_hours: DataFrame, rooms: DataFrame) -> DataFrame:
    """Area-weighted house mean of the hours every room with an area has."""
    site = Window.partitionBy("site_id")
    measured = (
        rooms.filter("area is not null")
        .groupBy("site_id", "floor_pos", "room_pos")
        .agg(F.max("area").alias("area"))
        .withColumn("_area", F.sum("area").over(site))
        .withColumn("_rooms", F.count(F.lit(1)).over(site))
    )
    return (
        room_hours.join(measured, ["site_id", "floor_pos", "room_pos"])
        .groupBy("site_id", "hour_ts")
        .agg(
            (F.sum(F.col("area") * F.col("mean")) / F.first("_area")).alias("house"),
            F.count(F.lit(1)).alias("_seen"),
            F.first("_rooms").alias("_rooms"),
        )
        .filter("_seen = _rooms")
        .select("site_id", "hour_ts", "house")
    )


def degree_hours(
    house: DataFrame, outside: DataFrame, tz: str | Column, keys: Sequence[str] = SITE
) -> DataFrame:
    """Per month, the hours both have and their difference; an hour joins a month by its middle.

    The outside hours come out of an explode, which size estimates do not see: a merge join keeps
    them from being broadcast, and the house hours already lie by the join's keys.
    """
    out = outside.select(*keys, "hour_ts", F.col("mean").alias("_out")).hint("merge")
    both = house.join(out, [*keys, "hour_ts"])
    month = C.month_start(C.local_day(F.col("hour_ts") + C.HOUR // 2, tz))
    hours, counted = F.col("hours"), F.col("counted_hours")
    return (
        both.groupBy(*keys, month.alias("month"))
        .agg(
            F.count(F.lit(1)).alias("counted_hours"),
            F.sum(F.col("house") - F.col("_out")).alias("degree_hours"),
            F.sum("house").alias("house_sum"),
        )
        .withColumn("hours", C.month_hours(F.col("month"), tz))
        .withColumn("whole_degree_hours", F.col("degree_hours") * hours / counted)
        .withColumn("coverage", counted / F.greatest(hours, F.lit(1)))
    )


def heating_months(
    heating: DataFrame,
    hours: DataFrame,
    options: HeatingOptions = HeatingOptions(),
    keys: Sequence[str] = SITE,
) -> DataFrame:
    """Months with why one does not count for the heat loss, in the order the reasons apply."""
    mild = F.coalesce(F.col("outside_mean") >= options.heating_base, F.lit(True))
    thin = F.coalesce(F.col("coverage") < MIN_HOUR_COVERAGE, F.lit(True))
    reason = F.when(~F.col("fitted"), "energy").when(mild, "mild").when(thin, "few_hours")
    return heating.join(hours, [*keys, "month"], "left").withColumn("not_counted", reason)


def heat_loss(months: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The loss line of each season and of the record, NULL where there is none that rises.

    ``slope`` is the degree-day line of the same months, kept beside it to attribute changes.
    """
    counted = F.col("not_counted").isNull()

    def over(column: str) -> Column:
        return F.coalesce(F.sum(F.when(counted, F.col(column))), F.lit(0))

    line = fit_line(
        F.when(counted, F.col("whole_degree_hours")),
        F.when(counted, F.col("heating_kwh")),
        MIN_DEGREE_HOUR_SPREAD,
    )
    facts = (
        by_season_and_all(months)
        .groupBy(*keys, "season")
        .agg(
            line.alias("_fit"),
            degree_day_line().getField("slope").alias("slope"),
            F.count_if(counted).alias("heating_months"),
            over("hours").alias("heating_hours"),
            over("counted_hours").alias("_counted"),
            over("house_sum").alias("_house"),
            F.coalesce(F.sum(F.when(F.col("sound"), F.col("heating_kwh"))), F.lit(0.0)).alias("sound_kwh"),
        )
        .withColumn("_line", F.when((F.col("_fit.slope") > 0) & (F.col("_counted") > 0), F.col("_fit")))
    )
    watts = -F.col("_line.base") * 1_000.0 / (F.col("heating_hours") / F.col("_line.points"))
    has = F.col("_line").isNotNull()
    return facts.select(
        *keys,
        "season",
        "heating_months",
        "heating_hours",
        "sound_kwh",
        "slope",
        F.col("_line.slope").alias("loss_slope"),
        (F.col("_line.slope") * 1_000.0).alias("watts_per_kelvin"),
        F.col("_line.r2").alias("r2"),
        F.col("_line.slope_error").alias("slope_error"),
        F.when(has, F.col("_house") / F.nullif(F.col("_counted"), F.lit(0).cast("bigint"))).alias("house"),
        F.when(has & (watts >= MIN_FREE_HEAT), watts).alias("free_heat_watts"),
    )


def change_cause(losses: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Each season against the last earlier one with both lines: held, building, behaviour or both."""
    rows = losses.filter("season is not null")
    both = F.col("slope").isNotNull() & F.col("loss_slope").isNotNull()
    state = F.when(both, F.struct("season", "slope", "loss_slope", "house"))
    before = Window.partitionBy(*keys).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_now", state).withColumn("_was", F.last("_now", True).over(before))
    usable = (
        F.col("_now").isNotNull()
        & F.col("_was").isNotNull()
        & (F.col("slope") > 0)
        & (F.col("_was.slope") > 0)
        & (F.col("_was.loss_slope") > 0)
    )
    ratios = seen.filter(usable).withColumn("_day", F.col("slope") / F.col("_was.slope")).withColumn(
        "_loss", F.col("loss_slope") / F.col("_was.loss_slope")
    )
    share = F.log("_loss") / F.nullif(F.log("_day"), F.lit(0.0))
    cause = (
        F.when(F.abs(F.col("_day") - 1) < HELD, "held")
        .when(share >= BUILDING_SHARE, "building")
        .when(share <= BEHAVIOUR_SHARE, "behaviour")
        .otherwise("both")
    )
    return ratios.select(
        *keys,
        "season",
        F.col("_was.season").alias("before"),
        (F.col("_day") - 1).alias("per_degree_day"),
        (F.col("_loss") - 1).alias("heat_loss"),
        (F.col("house") - F.col("_was.house")).alias("house"),
        cause.alias("cause"),
    )


def degree_warmer(losses: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """What a degree more costs over the heating hours, per season and for the record.

    ``by_overall_kwh`` uses the record's line; ``fullest`` marks the season with the most heating
    months, ties to the latest.
    """
    overall = F.max(F.when(F.col("season").isNull(), F.col("loss_slope"))).over(Window.partitionBy(*keys))
    rank = F.row_number().over(
        Window.partitionBy(*keys, F.col("season").isNull()).orderBy(
            F.desc("heating_months"), F.desc("season")
        )
    )
    kwh = F.col("loss_slope") * F.col("heating_hours")
    energy = F.when(F.col("sound_kwh") > 0, F.col("sound_kwh"))
    return (
        losses.withColumn("_all", overall)
        .withColumn("fullest", (rank == 1) & F.col("season").isNotNull() & (F.col("heating_months") > 0))
        .select(
            *keys,
            "season",
            "heating_months",
            "sound_kwh",
            "watts_per_kelvin",
            kwh.alias("degree_kwh"),
            (kwh / energy).alias("degree_share"),
            (F.col("_all") * F.col("heating_hours")).alias("by_overall_kwh"),
            "fullest",
        )
    )
