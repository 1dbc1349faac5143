"""Readings to intervals, calendars and clock changes: hand-computed values."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdspan.functions import calendar as C
from holdspan.functions import values as V
from holdspan.operators import intervals as I
from holdspan.options import GridOptions, ReadOptions

T0 = 1_718_960_400  # 2024-06-21 09:00 UTC
READING = "site_id bigint, series_id string, ts double, row_id bigint, value double"


def readings(spark, values, series="a"):
    return spark.createDataFrame([(0, series, float(t), i, v) for i, (t, v) in enumerate(values)], READING)


def test_states_hold_until_the_next_row_and_at_most_the_gap(spark):
    given = readings(spark, [(T0 + 600 * i, v) for i, v in enumerate([500.0, 1500.0, None, 2500.0, 0.0])])
    out = rows(I.state_samples(given, 900), "start_ts", "end_ts", "value")
    assert out == [
        (T0, T0 + 600, 500.0),
        (T0 + 600, T0 + 1200, 1500.0),
        (T0 + 1800, T0 + 2400, 2500.0),
        (T0 + 2400, T0 + 3300, 0.0),
    ]


def test_last_row_of_a_second_wins_and_may_be_unavailable(spark):
    given = readings(spark, [(T0 + 0.2, 1.0), (T0 + 0.9, 2.0), (T0 + 0.9, 3.0), (T0 + 10.5, 4.0), (T0 + 10.6, None)])
    assert rows(I.state_samples(given, 900), "start_ts", "end_ts", "value") == [(T0, T0 + 10, 3.0)]


def test_a_reading_before_the_window_carries_in(spark):
    given = readings(spark, [(T0 - 100, 7.0), (T0 + 50, 8.0)])
    out = rows(I.state_samples(given, 900, T0, T0 + 60), "start_ts", "end_ts", "value")
    assert out == [(T0, T0 + 50, 7.0), (T0 + 50, T0 + 60, 8.0)]


@pytest.mark.parametrize("gap", [60, 900, 86_400, 300_000])
def test_chunks_do_not_show(spark, gap):
    rng = random.Random(gap)
    at, given = T0 - T0 % 86_400, []
    for _ in range(400):
        at += rng.choice([1, 30, 500, 4_000, 40_000, 200_000])
        given.append((at, rng.choice([None, 1.0, 2.0])))
    want = []
    for i, (t, v) in enumerate(given):
        end = min(given[i + 1][0] if i + 1 < len(given) else t + gap, t + gap)
        if v is not None and end > t:
            want.append((t, end, v))
    assert rows(I.state_samples(readings(spark, given), gap), "start_ts", "end_ts", "value") == sorted(want)


def test_statistics_cover_their_interval_and_skip_null(spark):
    given = spark.createDataFrame(
        [(0, "a", float(T0 + 3600 * i), v) for i, v in enumerate([1000.0, 2000.0, None, 3000.0])],
        "site_id bigint, series_id string, start_ts double, mean double",
    )
    assert [v for _, _, v in rows(I.statistics_samples(given), "start_ts", "end_ts", "value")] == [1000.0, 2000.0, 3000.0]
    cut = rows(I.statistics_samples(given, from_ts=T0 + 1800, to_ts=T0 + 5400), "start_ts", "end_ts", "value")
    assert cut == [(T0 + 1800, T0 + 3600, 1000.0), (T0 + 3600, T0 + 5400, 2000.0)]


def test_changes_only_across_chunks(spark):
    day = 86_400
    values = [(0, 1.0), (10, 1.0), (day, 1.0), (3 * day, 2.0), (3 * day + 1, 2.0), (9 * day, 1.0), (9 * day + 5, 1.0)]
    out = rows(I.changes_only(readings(spark, values)), "ts", "value")
    assert out == [(0.0, 1.0), (3.0 * day, 2.0), (9.0 * day, 1.0)]


def hour_by_hour(start, end, zone):
    """Cut hour by hour, finding each cut anew from the wall clock."""
    out, at = [], start
    while at < end:
        wall = datetime.fromtimestamp(at, timezone.utc).astimezone(ZoneInfo(zone))
        nxt = min(at + 3600 - wall.minute * 60 - wall.second, end)
        out.append((at, nxt, wall.date(), wall.hour))
        at = nxt
    return out


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe"])
def test_hour_slices_over_clock_changes(spark, samples_of, zone):
    rng = random.Random(zone)
    middles = {
        "Europe/Berlin": [1_711_846_800, 1_729_990_800],
        "America/New_York": [1_710_054_000, 1_730_613_600],
        "Asia/Kolkata": [1_711_846_800],
        "Australia/Lord_Howe": [1_712_415_600, 1_728_142_200],
    }[zone]
    spans = []
    for i in range(60):
        start = rng.choice(middles) + rng.randint(-30_000, 30_000)
        spans.append((start, start + rng.choice([1, 500, 3_600, 20_000, 90_000])))
    given = samples_of([(s, e, i) for i, (s, e) in enumerate(spans)])
    want = sorted((i, *piece) for i, (s, e) in enumerate(spans) for piece in hour_by_hour(s, e, zone))
    got = rows(I.hour_slices(given, zone), "value", "start_ts", "end_ts", "day", "hour")
    assert got == [(float(i), *rest) for i, *rest in want]


def test_zone_may_differ_by_row(spark):
    given = spark.createDataFrame(
        [(0, "a", T0, T0 + 7200, 1.0, "Europe/Berlin"), (1, "a", T0, T0 + 7200, 1.0, "Asia/Kathmandu")],
        "site_id bigint, series_id string, start_ts bigint, end_ts bigint, value double, tz string",
    )
    got = rows(I.hour_slices(given, F.col("tz")), "site_id", "hour", "seconds")
    assert got == [(0, 11, 3600), (0, 12, 3600), (1, 14, 900), (1, 15, 3600), (1, 16, 2700)]


def test_results_do_not_depend_on_the_session_zone(spark, samples_of):
    given = samples_of([(1_711_800_000, 1_711_900_000, 1)])
    want = rows(I.hour_slices(given, "Europe/Berlin"), "start_ts", "day", "hour")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(I.hour_slices(given, "Europe/Berlin"), "start_ts", "day", "hour") == want
        # Text without a zone stays UTC.
        ts = spark.range(1).select(V.parse_timestamp(F.lit("2023-06-01 12:00")).alias("t")).first().t
        assert ts == 1_685_620_800
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_lengths(spark):
    days = spark.sql("select explode(array(date'2024-03-30', date'2024-03-31', date'2024-10-27')) as day")
    assert [r[0] for r in days.select(C.day_length(F.col("day"), "Europe/Berlin")).collect()] == [86_400, 82_800, 90_000]
    skipped = spark.sql("select explode(array(date'2018-11-03', date'2018-11-04', date'2018-11-05')) as day")
    found = [tuple(r) for r in skipped.select(C.day_length(F.col("day"), "America/Sao_Paulo"), C.midnight(F.col("day"), "America/Sao_Paulo")).collect()]
    assert [d for d, _ in found] == [86_400, 86_400, 86_400]
    assert found[1][1] == int(datetime(2018, 11, 4, 1, tzinfo=timezone(timedelta(hours=-2))).timestamp())


def test_values_and_timestamps_as_stored(spark):
    texts = [" 21.5 ", "5d", "inf", "nan", "1e3", "+.5", "", "unavailable", "1e999", "0x10"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.parse_value(F.col("t"))).collect()]
    assert got == [21.5, None, None, None, 1000.0, 0.5, None, None, None, None]
    stamps = {
        "2023-06-01 12:00:00.000000": 1_685_620_800,
        "2023-06-01T12:00:00+00:00": 1_685_620_800,
        "2023-06-01T14:00:00.5+02:00": 1_685_620_800,
        "2023-06-01T12:00:00Z": 1_685_620_800,
        "2023-06-01 12:00": 1_685_620_800,
        "2023-02-30 12:00:00": None,
        "yesterday": None,
    }
    df = spark.createDataFrame([(t,) for t in stamps], "t string").select("t", V.parse_timestamp(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == stamps


def test_units_convert_or_are_refused(spark):
    given = spark.createDataFrame([(1, "kW", 3.2), (2, "°F", 41.0), (3, None, 7.0), (4, "lx", 8.0)], "id int, unit string, value double")
    good, bad = V.convert_units(given, "power")
    assert rows(good, "id", "value") == [(1, 3200.0), (3, 7.0), (4, 8.0)] and rows(bad, "id") == [(2,)]
    warm, _ = V.convert_units(given.filter("id = 2"), "temperature")
    assert warm.first().value == pytest.approx(5.0)
    assert rows(V.convert_units(given, "power", explicit=2.0)[0], "id", "value")[1] == (2, 82.0)


def test_options_are_validated():
    for wrong in ({"max_gap": 0}, {"scale": 0.0}, {"from_ts": 5, "to_ts": 5}, {"source": "x"}):
        with pytest.raises(ValueError):
            ReadOptions(**wrong)
    with pytest.raises(ValueError):
        GridOptions(step=50, max_value=20)
