"""Degree days, meter lines, heat loss and benchmark with closed-form answers."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdspan.functions import calendar as C
from holdspan.operators import benchmark, degree, heatloss, meter
from holdspan.operators.regress import fit_line
from holdspan.plans.heating import degree_day_report
from holdspan.sources import rooms as dimension

TZ = "Europe/Berlin"
SITE = ("site_id",)
# Steady temperatures by month.
MONTHS = (0, 2, 5, 9, 13, 17, 19, 18, 15.5, 10, 5, 1)


def steady(spark, first, last, extra="0D"):
    """Hourly outside samples of a whole span of local days, by the month's temperature."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    table = F.array(*[F.lit(float(t)) for t in MONTHS])
    return days.select(
        F.lit(0).alias("site_id"),
        "day",
        C.midnight(F.col("day"), TZ).alias("start_ts"),
        C.midnight(F.date_add("day", 1), TZ).alias("end_ts"),
        (F.element_at(table, F.month("day")) + F.expr(extra)).alias("value"),
    )


def metered(outside):
    """A running total from 10,000: 2 kWh a degree day and 10 a day, read at each midnight."""
    from pyspark.sql import Window

    daily = 2.0 * F.greatest(F.lit(15.0) - F.col("value"), F.lit(0.0)) + 10.0
    first = outside.agg(F.min("start_ts")).first()[0]
    total = F.lit(10_000.0) + F.sum(daily).over(Window.partitionBy("site_id").orderBy("day"))
    start = outside.sparkSession.createDataFrame([(0, first, 10_000.0)], "site_id int, ts bigint, total double")
    return outside.select("site_id", F.col("end_ts").alias("ts"), total.alias("total")).unionByName(start)


def test_ten_days_at_five_degrees(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as day")
    given = days.select(
        F.lit(0).alias("site_id"), C.midnight(F.col("day"), TZ).alias("start_ts"),
        C.midnight(F.date_add("day", 1), TZ).alias("end_ts"), F.lit(5.0).alias("value"),
    )
    record = degree.period_summary(degree.daily_means(given, TZ, SITE), keys=SITE).filter("grain = 'record'").first()
    assert (record.hdd, record.cdd, record.days, record.possible_days, record.outside) == (100.0, 0.0, 10, 10, 5.0)


def test_a_short_day_does_not_count_but_is_possible(spark):
    at = 1_704_063_600  # 2024-01-01 00:00 in Berlin
    given = spark.createDataFrame(
        [(0, at, at + 86_400, 5.0), (0, at + 86_400, at + 86_400 + 70_000, 5.0), (0, at + 172_800, at + 259_200, 25.0)],
        "site_id int, start_ts bigint, end_ts bigint, value double",
    )
    days = degree.daily_means(given, TZ, SITE)
    record = degree.period_summary(days, keys=SITE).filter("grain = 'month'").first()
    assert (record.days, record.possible_days, record.hdd, record.cdd) == (2, 3, 10.0, 4.0)
    assert degree.counted_days(days, keys=SITE).first().short_days == 1


def test_a_room_of_two_sensors(spark):
    rooms = spark.createDataFrame(
        [(0, 0, "G", 0, "r", "a", None), (0, 0, "G", 0, "r", "b", None), (0, 0, "G", 1, "s", "c", None)],
        "site_id int, floor_pos int, floor string, room_pos int, room string, sensor string, area double",
    )
    day = dt.date(2024, 1, 1)
    days = spark.createDataFrame(
        [(0, "a", day, 20.0, 86_400, 86_400), (0, "b", day, 22.0, 40_000, 86_400), (0, "c", day, 18.0, 100, 86_400)],
        "site_id int, sensor string, day date, mean double, covered_seconds bigint, day_seconds bigint",
    )
    got = rows(degree.group_days(days, rooms), "room_pos", "mean", "covered_seconds", "partial")
    assert got == [(0, 20.0, 86_400, True), (1, 18.0, 100, False)]


def house(spark):
    """A house of 150 W/K in two rooms of 30 and 10 square metres at 21 and 17 degrees."""
    outside = steady(spark, "2022-07-01", "2024-06-30")
    inside = outside.select(
        "site_id", "start_ts", "end_ts", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sensor")
    ).withColumn("value", F.when(F.col("sensor") == "a", 21.0).otherwise(17.0))
    rooms = spark.createDataFrame(
        [(0, 0, "G", 0, "r", "a", 30.0), (0, 0, "G", 1, "s", "b", 10.0)],
        "site_id int, floor_pos int, floor string, room_pos int, room string, sensor string, area double",
    )
    houses = spark.createDataFrame([(0, None, 80.0)], "site_id int, heated_area double, total_area double")
    return outside, inside, rooms, houses


def test_a_meter_of_two_kwh_a_degree_day(spark):
    outside = steady(spark, "2022-07-01", "2024-06-30")
    days = degree.daily_means(outside, TZ, SITE)
    months = meter.left_out(meter.month_energy(meter.meter_readings(metered(outside)), days, TZ))
    assert months.filter("fitted").count() == 23
    heating = meter.heating_energy(months)
    for season in meter.efficiency(heating).collect():
        assert season.slope == pytest.approx(2.0, abs=0.02) and season.r2 > 0.999
    own = rows(meter.base_load(months), "season", "per_month")
    assert own[0][1] == pytest.approx(307, abs=1)


def test_fortnightly_readings_and_a_skipped_one(spark):
    outside = steady(spark, "2022-07-01", "2023-06-30")
    days = degree.daily_means(outside, TZ, SITE)
    total = metered(outside)
    first = outside.agg(F.min("start_ts")).first()[0]
    whole = meter.month_energy(meter.meter_readings(total), days, TZ)
    gap = total.filter((F.col("ts") < first + 100 * 86_400) | (F.col("ts") > first + 170 * 86_400))
    broken = meter.left_out(meter.month_energy(meter.meter_readings(gap), days, TZ))
    reasons = dict(rows(broken, "month", "left_out"))
    assert reasons[dt.date(2022, 11, 1)] == "unchanged" and reasons[dt.date(2022, 12, 1)] == "after_unchanged"
    assert whole.count() == 11 and rows(broken, "month")[0] == (dt.date(2022, 7, 1),)


def test_energy_and_loss_of_a_house(spark):
    outside, inside, rooms, houses = house(spark)
    # Heating follows the house exactly: 150 W for each kelvin it is warmer than outside, in the
    # cold months only, so that the base load is nothing.
    kwh = F.when(F.col("value") < 15, 0.150 * 24 * (20.0 - F.col("value"))).otherwise(F.lit(0.01))
    from pyspark.sql import Window

    total = F.sum(kwh).over(Window.partitionBy("site_id").orderBy("day"))
    totals = outside.select("site_id", F.col("end_ts").alias("ts"), total.alias("total"))
    tables = degree_day_report(outside, inside, totals, rooms, houses, TZ)
    record = tables["losses"].filter("season is null").first()
    assert record.watts_per_kelvin == pytest.approx(150, abs=1.0) and record.house == pytest.approx(20.0)
    causes = tables["causes"].collect()
    assert [c.cause for c in causes] == ["held"]
    year = tables["benchmark"].filter("latest").first()
    assert year.per_heated == pytest.approx(2 * year.per_total)
    warmer = tables["warmer"].filter("season is null").first()
    assert warmer.degree_kwh == pytest.approx(0.150 * record.heating_hours, rel=0.01)


def test_causes(spark):
    losses = spark.createDataFrame(
        [(0, 2020, 2.0, 0.15, 20.0), (0, 2021, None, 0.15, 20.0), (0, 2022, 1.5, 0.1125, 20.0), (0, 2023, 1.2, 0.1125, 19.0), (0, 2024, 1.21, 0.11, 19.0)],
        "site_id int, season int, slope double, loss_slope double, house double",
    )
    got = rows(heatloss.change_cause(losses), "season", "before", "cause")
    assert got == [(2022, 2020, "building"), (2023, 2022, "behaviour"), (2024, 2023, "held")]


def test_line_rules(spark):
    def line(points, spread=15.0):
        df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
        return df.agg(fit_line(F.col("x"), F.col("y"), spread).alias("l")).first().l

    assert line([(0, 1), (100, 2)]) is None and line([(0, 1), (5, 2), (10, 3)]) is None
    assert line([(5, 1), (5, 2), (5, 3)], 0.0)["slope"] is None
    flat = line([(0, 4), (10, 4), (20, 4)])
    assert (flat["slope"], flat["r2"], flat["base"]) == (0.0, 1.0, 4.0)
    noisy = line([(0, 1), (10, 0), (20, 3)])
    assert noisy["slope"] == pytest.approx(0.1) and noisy["slope_error"] == pytest.approx((8 / 3 / 200) ** 0.5)


def test_class_bounds_belong_to_the_worse_class(spark):
    got = [r[0] for r in spark.createDataFrame([(29.9,), (30.0,), (160.0,), (250.0,)], "v double").select(benchmark.efficiency_class(F.col("v"))).collect()]
    assert got == ["A+", "A", "F", "H"]


def test_dimension_checks(spark):
    _, _, rooms, houses = house(spark)
    assert dimension.check_rooms(rooms, houses).count() == 0
    area = dimension.house_areas(rooms, houses).first()
    assert (area.rooms_area, area.heated_area, area.heated_from_rooms) == (40.0, 40.0, True)
    small = houses.withColumn("total_area", F.lit(30.0))
    assert rows(dimension.check_rooms(rooms, small), "code") == [("total_below_heated",)]
