"""Meter energy by calendar month, set against the weather of the month.

Months per site are few (the calendar bounds them), so windows over them are per site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan.functions import calendar as C
from holdspan.options import HeatingOptions
from holdspan.operators.chunks import as_of
from holdspan.operators.degree import heating_degrees, is_counted
from holdspan.operators.intervals import changes_only
from holdspan.operators.regress import fit_line

SITE = ("site_id",)
# Coverage of a month, spread of degree days a line needs, and the warm months the
# base load is taken from.
MIN_MONTH_COVERAGE = 0.9
MIN_SPREAD = 15.0
WARM_MONTHS = (5, 6, 7, 8, 9)
BASE_LOAD_MONTHS = 3


def meter_readings(totals: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Readings of a running total, repeats dropped; ``totals``: keys, ts, total."""
    return changes_only(totals, "total", ("ts", "total"), keys)


def asof_total(probes: DataFrame, readings: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Each probe (keys, ts, ...) with the last total at or before it."""
    return as_of(probes, readings, keys, "total", "total")


def _months(
    readings: DataFrame,
    outside: DataFrame,
    tz: str | Column,
    options: HeatingOptions,
    keys: Sequence[str],
) -> DataFrame:
    """Every month from the first reading to the end of the data: what it opens with, its weather.

    Readings and outside days meet in one aggregation by month, which combines before its only
    shuffle; all else is windows over a site's months. A reading at the very midnight of a 1st
    still belongs to the month before. The data ends with the later of the last reading and the
    outside record: a total that stands still leaves no reading of its own.
    """
    home = C.month_start(C.local_day(F.col("ts") - 1, tz))
    counted = F.when(is_counted(options.min_coverage), F.col("mean"))
    read = readings.select(
        *keys, home.alias("month"), F.struct("ts", "total").alias("reading")
    )
    weather = outside.select(
        *keys, C.month_start(F.col("day")).alias("month"), "day", counted.alias("counted")
    )
    reading = F.col("reading")
    on_first = reading.getField("ts") <= C.midnight(F.date_add("month", 1), tz)
    site = Window.partitionBy(*keys)
    order = site.orderBy("month")
    rows = (
        read.unionByName(weather, allowMissingColumns=True)
        .groupBy(*keys, "month")
        .agg(
            F.min("reading").alias("first"),
            F.max("reading").alias("last"),
            F.max(F.when(on_first, reading)).alias("early"),
            F.count("counted").alias("counted_days"),
            F.sum(heating_degrees(F.col("counted"), options.heating_base)).alias("hdd"),
            F.avg("counted").alias("outside_mean"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        )
        .withColumns(
            {
                "_opened": F.min("first").over(site),
                "_first_day": F.min("first_day").over(site),
                "_last_day": F.max("last_day").over(site),
                "_data_end": F.greatest(
                    F.max("last.ts").over(site),
                    C.midnight(F.date_add(F.max("last_day").over(site), 1), tz),
                ),
                "_before": F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                "_known": F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "_next": F.lead("month").over(order),
            }
        )
    )
    # Months without any row lie between a row's month and the next one's.
    end = C.month_start(C.local_day(F.col("_data_end"), tz))
    until = F.coalesce(F.add_months("_next", -1), F.greatest("month", end))
    spread = rows.withColumn(
        "_month", F.explode(F.sequence("month", until, F.expr("interval 1 month")))
    )
    own = F.col("_month") == F.col("month")
    start = F.when(own, F.col("_before")).otherwise(F.col("_known"))
    after = F.when(own, F.coalesce("early", "_before")).otherwise(F.col("_known"))
    first_month = C.month_start(C.local_day(F.col("_opened.ts"), tz))
    return spread.filter(F.col("_month").between(first_month, end)).select(
        *keys,
        F.col("_month").alias("month"),
        start.alias("_start"),
        after.alias("_after"),
        F.when(own, F.col("counted_days")).otherwise(F.lit(0)).alias("counted_days"),
        F.coalesce(F.when(own, F.col("hdd")), F.lit(0.0)).alias("hdd"),
        F.when(own, F.col("outside_mean")).alias("outside_mean"),
        "_opened",
        "_data_end",
        "_first_day",
        "_last_day",
    )


def month_start_total(
    readings: DataFrame,
    outside: DataFrame,
    tz: str | Column,
    options: HeatingOptions = HeatingOptions(),
    keys: Sequence[str] = SITE,
) -> DataFrame:
    """The total each month opens with, beside the month's weather.

    The last reading at or before the 1st's midnight, unless none was taken during the day before
    or the total is lower a day later: then the total at the end of the 1st. A history that begins
    on the 1st opens with its first reading. ``readings`` must be changes only.
    """
    start, after = F.col("_start.total"), F.col("_after.total")
    recent = F.col("_start.ts") > C.midnight(F.date_sub("month", 1), tz)
    total = (
        F.when(start.isNull() & after.isNotNull(), F.col("_opened.total"))
        .when(start.isNotNull() & after.isNotNull() & (~recent | (after < start)), after)
        .otherwise(start)
    )
    months = _months(readings, outside, tz, options, keys)
    return months.withColumn("total", total).drop("_start", "_after", "_opened")


def month_energy(
    readings: DataFrame,
    outside: DataFrame,
    tz: str | Column,
    options: HeatingOptions = HeatingOptions(),
    keys: Sequence[str] = SITE,
) -> DataFrame:
    """kWh and weather of every closed month whose opening and closing are known.

    A month is closed once the midnight after the next 1st is within the data. ``beyond`` marks
    months outside the months of the outside record.
    """
    order = Window.partitionBy(*keys).orderBy("month")
    closed = C.midnight(F.date_add(F.add_months("month", 1), 1), tz) <= F.col("_data_end")
    first, last = C.month_start(F.col("_first_day")), C.month_start(F.col("_last_day"))
    inside = F.coalesce(F.col("month").between(first, last), F.lit(False))
    return (
        month_start_total(readings, outside, tz, options, keys)
        .withColumn("_closing", F.lead("total").over(order))
        .filter(closed & F.col("total").isNotNull() & F.col("_closing").isNotNull())
        .select(
            *keys,
            "month",
            (F.col("_closing") - F.col("total")).alias("kwh"),
            (~inside).alias("beyond"),
            "counted_days",
            "hdd",
            "outside_mean",
        )
    )


def month_weather(
    outside: DataFrame, options: HeatingOptions = HeatingOptions(), keys: Sequence[str] = SITE
) -> DataFrame:
    """Counted days, heating degree days and mean temperature per calendar month."""
    return (
        outside.filter(is_counted(options.min_coverage))
        .groupBy(*keys, C.month_start(F.col("day")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("counted_days"),
            F.sum(heating_degrees(F.col("mean"), options.heating_base)).alias("hdd"),
            F.avg("mean").alias("outside_mean"),
        )
    )


def whole_month_hdd(hdd: Column, counted: Column, days: Column) -> Column:
    """Degree days scaled from the counted days to the whole month."""
    return F.when(counted > 0, hdd * days / counted).otherwise(F.lit(0.0))


def left_out(energy: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Months of the record and why one is left out of the fits, if it is.

    ``sound`` months have usable energy, whatever the weather record misses.
    """
    months = energy.filter("not beyond").drop("beyond")
    order = Window.partitionBy(*keys).orderBy("month")
    stuck = (F.lag("month").over(order) == F.add_months("month", -1)) & (F.lag("kwh").over(order) == 0)
    days = C.month_days(F.col("month"))
    kwh = F.col("kwh")
    reason = (
        F.when(kwh < 0, "went_down")
        .when(kwh == 0, "unchanged")
        .when(F.col("_stuck"), "after_unchanged")
        .when(F.col("counted_days") < MIN_MONTH_COVERAGE * days, "few_days")
    )
    return (
        months.withColumn("_stuck", F.coalesce(stuck, F.lit(False)))
        .withColumn("left_out", reason)
        .withColumn("fitted", F.col("left_out").isNull())
        .withColumn("sound", F.col("fitted") | (F.col("left_out") == "few_days"))
        .withColumn("season", C.heating_season(F.col("month")))
        .withColumn("whole_hdd", whole_month_hdd(F.col("hdd"), F.col("counted_days"), days))
        .drop("_stuck")
    )


def with_base_load(months: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Months with the base load of their season, or of the nearest season that has one.

    A season's own is the energy of its three warmest fitted summer months. Nearest is the last
    such season up to this one or the first from it on, ties to the earlier. Windows over a site's
    months only: no join and no further shuffle.
    """
    warm = F.col("fitted") & F.month("month").isin(*WARM_MONTHS) & F.col("outside_mean").isNotNull()
    season = Window.partitionBy(*keys, "season")
    rank = F.row_number().over(
        Window.partitionBy(*keys, "season", "_warm").orderBy(F.desc("outside_mean"), "month")
    )
    chosen = F.col("_warm") & (F.col("_rank") <= BASE_LOAD_MONTHS)
    kwh = F.sum(F.when(chosen, F.col("kwh"))).over(season)
    days = F.sum(F.when(chosen, C.month_days(F.col("month")))).over(season)
    complete = F.count(F.when(chosen, F.lit(1))).over(season) == BASE_LOAD_MONTHS
    load = F.struct(
        "season", (kwh / days).alias("per_day"), (kwh / BASE_LOAD_MONTHS).alias("per_month")
    )
    by_season = Window.partitionBy(*keys).orderBy("season")
    back = F.last("_own", True).over(by_season.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("_own", True).over(by_season.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    earlier = F.col("_ahead").isNull() | (
        F.col("season") - F.col("_back.season") <= F.col("_ahead.season") - F.col("season")
    )
    near = F.when(F.col("_back").isNull() | ~earlier, F.col("_ahead")).otherwise(F.col("_back"))
    return (
        months.withColumn("_warm", warm)
        .withColumn("_rank", rank)
        .withColumn("_own", F.when(complete, load))
        .withColumns({"_back": back, "_ahead": ahead})
        .withColumn("_near", near)
        .withColumns(
            {
                "from_season": F.col("_near.season"),
                "per_day": F.col("_near.per_day"),
                "per_month": F.col("_near.per_month"),
            }
        )
        .drop("_warm", "_rank", "_own", "_back", "_ahead", "_near")
    )


def nearest_base_load(months: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Every season with the base load it uses and the season that comes from."""
    return with_base_load(months, keys).select(
        *keys, "season", "from_season", "per_day", "per_month"
    ).distinct()


def base_load(months: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The seasons that have a base load of their own, a day and a month."""
    own = nearest_base_load(months, keys).filter("season = from_season")
    return own.select(*keys, "season", "per_day", "per_month")


def mean_base_load(own: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The average month of the seasons that have a base load of their own."""
    return own.groupBy(*keys).agg(F.avg("per_month").alias("base_per_month"))


def heating_energy(months: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Months with the base load taken off every day of them."""
    water = F.coalesce(F.col("per_day") * C.month_days(F.col("month")), F.lit(0.0))
    return (
        with_base_load(months, keys)
        .withColumn("base_kwh", water)
        .withColumn("heating_kwh", F.col("kwh") - F.col("base_kwh"))
        .drop("per_day")
    )


def by_season_and_all(rows: DataFrame) -> DataFrame:
    """Each row twice: under its season, and under the whole record (NULL season)."""
    return rows.withColumn(
        "season", F.explode(F.array(F.col("season"), F.lit(None).cast("int")))
    )


def degree_day_line() -> Column:
    """Aggregate over heating months: the line of heating energy on whole-month degree days."""
    fitted = F.col("fitted")
    return fit_line(
        F.when(fitted, F.col("whole_hdd")), F.when(fitted, F.col("heating_kwh")), MIN_SPREAD
    )


def efficiency(heating: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """kWh per degree day: a line through the fitted months of each season and of the record."""
    return (
        by_season_and_all(heating)
        .groupBy(*keys, "season")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.count_if("fitted").alias("fitted"),
            F.coalesce(F.sum(F.when(F.col("sound"), F.col("heating_kwh"))), F.lit(0.0)).alias("sound_kwh"),
            F.when(F.col("season").isNotNull(), F.first("per_month")).alias("per_month"),
            F.when(F.col("season").isNotNull(), F.first("from_season")).alias("from_season"),
            degree_day_line().alias("_line"),
        )
        .select(*keys, "season", "months", "fitted", "sound_kwh", "per_month", "from_season", "_line.*")
    )


def season_change(seasons: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Seasons with their slope's change against the last earlier season that has one."""
    order = Window.partitionBy(*keys).orderBy("season")
    known = F.when(F.col("slope").isNotNull(), F.struct("season", "slope"))
    before = F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        seasons.filter("season is not null")
        .withColumn("_before", before)
        .withColumn("before", F.when(F.col("slope").isNotNull(), F.col("_before.season")))
        .withColumn("change", F.col("slope") / F.nullif(F.col("_before.slope"), F.lit(0.0)) - 1)
        .drop("_before")
    )


def month_report(heating: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The month table: energy split, weather, and the reason a month is left out."""
    hdd = F.when(F.col("counted_days") > 0, F.col("whole_hdd"))
    return heating.select(
        *keys,
        "month",
        F.concat_ws(" ", C.month_name(F.month("month")), F.year("month").cast("string")).alias("label"),
        "kwh",
        "base_kwh",
        "heating_kwh",
        "counted_days",
        "outside_mean",
        hdd.alias("whole_hdd"),
        (F.col("heating_kwh") / F.nullif(hdd, F.lit(0.0))).alias("per_degree_day"),
        "left_out",
    )


def season_report(seasons: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The season table: months, energy, line, base load with its source, change."""
    return season_change(seasons, keys).select(
        *keys,
        "season",
        C.season_label(F.col("season")).alias("label"),
        "months",
        "fitted",
        "sound_kwh",
        "slope",
        "slope_error",
        "r2",
        "per_month",
        "from_season",
        "before",
        "change",
    )
