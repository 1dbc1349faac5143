"""Meters and thermometers from recorder tables."""

from conftest import rows

from holdspan.operators import offset
from holdspan.sources.load import Tables, load_totals

HISTORY = "site_id int, setting string, ts bigint, row_id bigint, value double"
READING = "site_id int, sensor string, ts bigint, row_id bigint, value double"


def totals(spark, meta, statistics, states):
    meta = spark.createDataFrame(meta, "site_id int, metadata_id bigint, series_id string, unit string")
    hourly = spark.createDataFrame(statistics, "site_id int, metadata_id bigint, start_ts double, mean double, state double")
    raw = spark.createDataFrame(states, "site_id int, series_id string, row_id bigint, ts double, state string")
    meters = spark.createDataFrame([(0, "m"), (1, "m"), (2, "m"), (2, "m")], "site_id int, series_id string")
    return load_totals(meters, Tables(meta, hourly, hourly, raw), lambda df: df)


def test_a_meter_is_read_from_statistics_before_raw_states(spark):
    meta = [(0, 7, "m", " Wh "), (1, 7, "m", "MWh"), (2, 7, "m", "L"), (0, 8, "other", "kWh")]
    hourly = [(0, 7, 0.0, 5.0, 1_000.0), (0, 7, 3_600.0, 2_000.0, None), (0, 8, 0.0, None, 9.0), (1, 7, 0.0, None, None), (2, 7, 0.0, None, 4.0)]
    raw = [(0, "m", 1, 50.0, "99"), (1, "m", 1, 60.5, "12.5"), (1, "m", 2, 70.0, "unavailable")]
    found = totals(spark, meta, hourly, raw)
    # Statistics without a single total leave the meter to its raw states, which are kWh whatever the unit says.
    assert rows(found.readings, "site_id", "ts", "total") == [(0, 3_600, 1.0), (0, 7_200, 2.0), (1, 60, 12.5)]
    assert rows(found.provenance, "site_id", "source", "scale") == [(0, "statistics", 0.001), (1, "states", 1.0)]
    assert rows(found.refused, "site_id", "unit") == [(2, "L")]


def test_meters_without_any_table(spark):
    found = totals(spark, [(9, 1, "m", "kWh")], [(9, 1, 0.0, 1.0, 1.0)], [(9, "m", 1, 0.0, "1")])
    assert found.readings.count() == 0
    assert rows(found.provenance, "site_id", "source") == [(0, "states"), (1, "states"), (2, "states")]


def test_only_a_sensor_with_one_recorded_setting_is_corrected(spark):
    names = [f"sensor.{n}_temperature" for n in ("bath", "hall", "study", "attic")]
    sensors = spark.createDataFrame([(0, n, 2.0) for n in names], "site_id int, sensor string, scale double")
    settings = ["number.bath_temperature_offset", "number.hall_temperature_offset", "number.hall_local_calibration", "number.study_temperature_offset"]
    known = spark.createDataFrame([(0, s) for s in settings], "site_id int, setting string")
    history = spark.createDataFrame(
        [(0, settings[0], 1_000, 1, 0.0), (0, settings[0], 5_000, 2, 1.5), (0, settings[1], 1_000, 1, 3.0)], HISTORY
    )
    # The readings fall when the setting rises, so it is subtracted by the device and added again here.
    moved = spark.createDataFrame([(0, names[0], 4_800, 1, 20.0), (0, names[0], 5_050, 2, 18.5)], READING)
    samples = spark.createDataFrame(
        [(0, n, 0, 10_000, 20.0) for n in names], "site_id int, sensor string, start_ts bigint, end_ts bigint, value double"
    )
    corrected, findings = offset.take_out_offsets(samples, sensors, known, history, moved)
    # 1.5 degrees of the setting are 3 of the samples.
    assert rows(corrected, "sensor", "start_ts", "end_ts", "value") == sorted(
        [(names[0], 0, 5_000, 20.0), (names[0], 5_000, 10_000, 23.0)] + [(n, 0, 10_000, 20.0) for n in names[1:]]
    )
    assert {r["sensor"].split(".")[1].split("_")[0]: (r["finding"], r["check"], r["assumed_before"]) for r in findings.collect()} == {
        "bath": ("corrected", "subtracted", 1_000),
        "hall": ("ambiguous", None, None),
        "study": ("unrecorded", None, None),
        "attic": ("none", None, None),
    }


def test_the_report_does_not_go_back_to_the_orders(spark, tmp_path, monkeypatch):
    from checks import q_house
    from checks.fixtures import Fixtures

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(q_house, "recorded_heating", lambda *given, **named: given)
    _, meters, tables, dim, houses, *_ = q_house.house(Fixtures(spark, "/root/testdata/sf0.001"))
    files = [f for df in (meters, tables.statistics, tables.short_term, tables.states, dim, houses) for f in df.inputFiles()]
    assert not [f for f in files if "orders" in f]
    assert tables.states.count() > 0 and tables.statistics.count() > 0
