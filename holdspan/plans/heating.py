"""The heating report: degree days, energy, heat loss and benchmark of a fleet of houses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.options import HeatingOptions, ReadOptions
from holdspan.operators import benchmark, coverage, degree, heatloss, meter, offset
from holdspan.operators.intervals import setting_history
from holdspan.operators.settle import settled
from holdspan.sources.load import Tables, load_samples, load_totals
from holdspan.sources.rooms import house_areas

SITE = ("site_id",)


def degree_day_report(
    outside: DataFrame,
    inside: DataFrame,
    totals: DataFrame,
    rooms: DataFrame,
    houses: DataFrame,
    tz: str | Column,
    options: HeatingOptions = HeatingOptions(),
    grains: tuple[str, ...] = ("month", "year", "record"),
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
    floors: int = 0,
    gap_threshold: int = 86_400,
) -> dict[str, DataFrame]:
    """Every table of the report.

    ``outside``: site_id and interval columns; ``inside``: the same with ``sensor``; ``totals``:
    site_id, ts, total in kWh. Offsets are to be taken out of ``inside`` before, as
    :func:`recorded_heating` does. ``settle`` is applied where tables branch (day means, heating months,
    month hours); pass :func:`holdspan.operators.settle.settled` when many of them are wanted.
    ``floors`` is how many floor columns the period table has; with none it is left out.
    """
    cover = options.min_coverage
    outside_days = settle(degree.daily_means(outside, tz, SITE))
    sensor_days = degree.daily_means(inside, tz, ("site_id", "sensor"))
    room_days = degree.group_days(sensor_days, rooms, cover)
    periods = degree.period_summary(outside_days, options, grains, SITE)
    by_room = degree.room_means(room_days, outside_days, cover, grains)

    readings = meter.meter_readings(totals, SITE)
    months = meter.left_out(meter.month_energy(readings, outside_days, tz, options, SITE), SITE)
    heating = settle(meter.heating_energy(months, SITE))
    seasons = meter.efficiency(heating, SITE)

    outside_hours = heatloss.hourly_means(outside, cover, SITE)
    sensor_hours = heatloss.hourly_means(inside, cover, ("site_id", "sensor"))
    house = heatloss.house_hours(heatloss.group_hours(sensor_hours, rooms), rooms)
    hours = heatloss.degree_hours(house, outside_hours, tz, SITE)
    counted = settle(heatloss.heating_months(heating, hours, options, SITE))
    losses = heatloss.heat_loss(counted, SITE)

    years = benchmark.sound_years(heating, SITE)
    by_floor = degree.floor_means(by_room)
    holes = coverage.outages(outside, gap_threshold, SITE)
    tables = {"period_table": degree.period_report(periods, by_floor, floors)} if floors else {}
    return tables | {
        "outside_days": outside_days,
        "periods": periods,
        "rooms": by_room,
        "floors": by_floor,
        "coldest": degree.coldest_period(periods, keys=SITE),
        "partial_days": degree.partial_days(room_days),
        "outages": holes,
        "coverage": thermometer_coverage(outside, outside_days, holes, tz, SITE),
        "base_load": meter.mean_base_load(meter.base_load(months, SITE), SITE),
        "months": meter.month_report(heating, SITE),
        "seasons": meter.season_report(seasons, SITE),
        "efficiency": seasons,
        "loss_months": counted,
        "losses": losses,
        "causes": heatloss.change_cause(losses, SITE),
        "warmer": heatloss.degree_warmer(losses, SITE),
        "benchmark": benchmark.per_square_metre(years, house_areas(rooms, houses), SITE),
    }


def thermometer_coverage(
    samples: DataFrame, days: DataFrame, holes: DataFrame, tz: str | Column, keys: Sequence[str] = SITE
) -> DataFrame:
    """Coverage of a thermometer, with its full days and its missing months counted from its day means."""
    span = coverage.spans(samples, tz, keys)
    counted = coverage.thermometer_days(days, keys)
    present = counted.select(*keys, F.explode("months").alias("facet"))
    missing = coverage.missing_facets(span, present, "month", keys)
    return coverage.coverage_flags(coverage.coverage_summary(span, counted, holes, missing, keys))


def recorded_heating(
    thermometers: DataFrame,
    meters: DataFrame,
    tables: Tables,
    rooms: DataFrame,
    houses: DataFrame,
    read: ReadOptions = ReadOptions(),
    options: HeatingOptions = HeatingOptions(),
    floors: int = 0,
    settle: Callable[[DataFrame], DataFrame] = settled,
) -> dict[str, DataFrame]:
    """The report straight from recorder tables.

    ``thermometers`` and ``meters`` (keys) name the outside thermometer and the running heating energy of a
    site; ``rooms`` names the sensors inside. Negative temperatures stay. Settings that correct a sensor are
    found among the states of the same site and taken out before days and hours are counted: ``findings``
    has a row a sensor. ``readiness`` says what an analysis of a site waits for. ``provenance``,
    ``refused``, ``meters`` and ``refused_meters`` are those of the loads.
    """
    outdoors = thermometers.select(*KEYS).distinct()
    indoors = rooms.select("site_id", F.col("sensor").alias("series_id")).distinct()
    loaded = load_samples(
        outdoors.unionByName(indoors), tables.meta, tables.statistics, tables.short_term, tables.states,
        "temperature", read, settle=settle,
    )
    totals = load_totals(meters, tables, settle)
    # Days, hours, coverage and the readings of the months all branch from here.
    readings = settle(totals.readings.drop("series_id"))
    outside = settle(loaded.samples.join(outdoors, list(KEYS), "left_semi").drop("series_id"))
    inside = loaded.samples.join(indoors, list(KEYS), "left_semi").withColumnRenamed("series_id", "sensor")

    # Statements about ids alone: both filters reach the scan of the states.
    settings = tables.states.filter(
        F.col("series_id").startswith("number.") & F.col("series_id").rlike("|".join(offset.OFFSET_WORDS))
    ).withColumnRenamed("series_id", "setting")
    names = settle(settings.select("site_id", "setting").distinct())
    sensors = settle(
        loaded.provenance.join(indoors, list(KEYS), "left_semi").select("site_id", F.col("series_id").alias("sensor"), "scale")
    )
    raw = setting_history(
        tables.states.join(offset.match_settings(sensors, names).select("site_id", F.col("sensor").alias("series_id")), list(KEYS), "left_semi")
    ).withColumnRenamed("series_id", "sensor")
    inside, findings = offset.take_out_offsets(
        inside, sensors, names, setting_history(settings, offset.SETTING), raw, settle
    )
    report = degree_day_report(
        outside, settle(inside), readings, rooms, houses, read.tz, options,
        settle=settle, floors=floors, gap_threshold=read.gap_threshold,
    )
    return report | {
        "findings": findings,
        "readiness": analysis_readiness(outdoors, totals.provenance, rooms, houses),
        "provenance": loaded.provenance,
        "refused": loaded.refused,
        "meters": totals.provenance,
        "refused_meters": totals.refused,
    }


# What each analysis needs.
NEEDS = {
    "degree_day_cost": ("energy",),
    "building_or_behaviour": ("energy", "rooms", "room_areas"),
    "degree_warmer": ("energy", "rooms", "room_areas"),
    "benchmark": ("energy", "rooms", "heated_area"),
    "indoor_temperatures": ("rooms",),
}


def analysis_readiness(
    sites: DataFrame, energy: DataFrame, rooms: DataFrame, houses: DataFrame
) -> DataFrame:
    """Per site, the analyses that cannot run and what each one lacks."""
    areas = house_areas(rooms, houses.join(rooms.select("site_id").distinct(), "site_id", "left_semi"))
    given = (
        sites.select("site_id")
        .distinct()
        .join(energy.select("site_id").distinct().withColumn("energy", F.lit(True)), "site_id", "left")
        .join(areas.withColumn("rooms", F.lit(True)), "site_id", "left")
        .select(
            "site_id",
            F.coalesce("energy", F.lit(False)).alias("energy"),
            F.coalesce("rooms", F.lit(False)).alias("rooms"),
            F.coalesce(F.col("rooms_area") > 0, F.lit(False)).alias("room_areas"),
            F.col("heated_area").isNotNull().alias("heated_area"),
        )
    )
    waiting = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in needs])).alias("needs"),
            )
            for section, needs in NEEDS.items()
        ]
    )
    return (
        given.select("site_id", F.explode(waiting).alias("_w"))
        .select("site_id", "_w.section", F.explode("_w.needs").alias("need"))
    )
