"""Settings that correct a sensor."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdspan.operators import offset

HISTORY = "site_id int, setting string, ts bigint, row_id bigint, value double"
READING = "site_id int, sensor string, ts bigint, row_id bigint, value double"


def matches(spark, sensor, *settings):
    sensors = spark.createDataFrame([(0, sensor)], "site_id int, sensor string")
    known = spark.createDataFrame([(0, s) for s in settings], "site_id int, setting string")
    return [s for (s,) in rows(offset.match_settings(sensors, known), "setting")]


def test_settings_of_the_same_device_only(spark):
    found = matches(
        spark, "sensor.bath_temperature", "number.bath_temperature_offset", "number.bath_2_temperature_offset",
        "number.bath_local_temperature_calibration", "number.bathroom_temperature_offset", "number.bath_boost_offset", "number.bath_temperature",
    )
    assert found == ["number.bath_local_temperature_calibration", "number.bath_temperature_offset"]
    assert matches(spark, "sensor.temperature", "number.temperature_offset") == []
    assert matches(spark, "sensor.flur_temperatur", "number.flur_temperaturkorrektur") == ["number.flur_temperaturkorrektur"]


def steps(spark, values):
    return offset.setting_intervals(
        spark.createDataFrame([(0, "n", t, i, float(v)) for i, (t, v) in enumerate(values)], HISTORY)
    ).withColumnRenamed("setting", "sensor")


def test_samples_are_cut_where_the_setting_changes(spark):
    day = 86_400
    given = steps(spark, [(day + 100, -1), (day + 200, -1), (3 * day + 500, -2)])
    samples = spark.createDataFrame(
        [(0, "n", 0, 4 * day, 20.0), (0, "n", 4 * day, 4 * day + 10, 21.0)],
        "site_id int, sensor string, start_ts bigint, end_ts bigint, value double",
    )
    got = rows(offset.apply_offset(samples, given), "start_ts", "end_ts", "value")
    assert got == [(0, 3 * day + 500, 21.0), (3 * day + 500, 4 * day, 22.0), (4 * day, 4 * day + 10, 23.0)]


SAMPLE = "site_id int, sensor string, start_ts bigint, end_ts bigint, value double"
SPAN = "site_id int, sensor string, from_ts bigint, to_ts bigint, degrees double, way int"


def corrected_by_loop(samples, spans):
    """Each sample against each setting of its sensor."""
    out = []
    for site, sensor, start, end, value in samples:
        own = [p for p in spans if p[:2] == (site, sensor) and p[4] is not None and site is not None]
        if not own:
            out.append((site, start, end, value))
        for _, _, lo, hi, degrees, way in own:
            if min(end, hi) > max(start, lo):
                out.append((site, max(start, lo), min(end, hi), value - way * 0.5 * degrees))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_against_a_loop(spark, seed):
    """Gaps, changes inside a sample, at its ends and days before it, settings without degrees, null keys."""
    rng = random.Random(seed)
    samples, spans = [], []
    for site in (0, 1, 2, 3, None):
        at = 0
        while at < 6_000:
            length = rng.choice([1, 10, 50, 700])
            samples.append((site, "n", at, at + length, float(rng.randint(0, 50))))
            at += length + rng.choice([0, 0, 0, 5, 400])
        if site == 3:
            continue
        ends = sorted({rng.choice([rng.randint(-500, 6_500), rng.choice(samples)[2]]) for _ in range(rng.choice([1, 4, 30]))})
        for lo, hi in zip([offset.ALWAYS, *ends], [*ends, offset.FOREVER], strict=True):
            if rng.random() < 0.9:
                spans.append((site, "n", lo, hi, rng.choice([None, 1.0, 2.0, 4.0]), rng.choice([1, -1])))
    given = spark.createDataFrame(samples, SAMPLE).repartition(3), spark.createDataFrame(spans, SPAN)
    got = offset.apply_offset(*given, sign=F.col("way"), scale=0.5, seconds=rng.choice([60, 1_000, 86_400]))
    assert sorted(map(tuple, got.select("site_id", "start_ts", "end_ts", "value").collect()), key=str) == corrected_by_loop(samples, spans)


def test_a_setting_costs_one_row_and_events_one_shuffle(spark, tmp_path):
    year = 365 * 86_400
    spark.createDataFrame([(0, "n", k * 3600, (k + 1) * 3600, 20.0) for k in range(200)], SAMPLE).write.parquet(str(tmp_path / "samples"))
    spark.createDataFrame([(0, "n", -10 * year, 10 * year, 1.0, 1)], SPAN).write.parquet(str(tmp_path / "spans"))
    got = offset.apply_offset(spark.read.parquet(str(tmp_path / "samples")), spark.read.parquet(str(tmp_path / "spans")))
    assert len(got.collect()) == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "ReusedExchange" in final and final.count("Exchange hashpartitioning") <= 4
    assert "Generate" not in plan
    assert got.agg(F.sum("value")).first()[0] == 200 * 19.0


@pytest.mark.parametrize("sign, check", [(1, "added"), (-1, "subtracted"), (0, "unmoved")])
def test_direction_from_how_readings_move(spark, sign, check):
    at = 100 * 3600
    given = steps(spark, [(0, -1), (at, -2)])
    readings = spark.createDataFrame(
        [(0, "n", t, t, 20.0 + (sign * -1.0 if t >= at else 0.0)) for t in range(at - 3000, at + 3000, 300)], READING
    )
    judged = offset.judged_changes(given, readings)
    found = offset.offset_direction(judged, readings).first()
    assert found.check == check and found.sign == (-1 if check == "subtracted" else 1)


def test_old_readings_and_small_changes_are_not_judged(spark):
    at = 100 * 3600
    stale = spark.createDataFrame([(0, "n", at - 1_861, 1, 20.0), (0, "n", at + 10, 2, 19.0)], READING)
    fresh = spark.createDataFrame([(0, "n", at - 1_860, 1, 20.0), (0, "n", at + 10, 2, 19.0)], READING)
    big, small = steps(spark, [(0, -1), (at, -2)]), steps(spark, [(0, -1), (at, -1.4)])
    assert offset.judged_changes(big, stale).count() == 0 and offset.judged_changes(big, fresh).count() == 1
    assert offset.judged_changes(small, fresh).count() == 0
    found = offset.offset_direction(offset.judged_changes(big, stale), stale).first()
    assert found.check == "untested"


def test_the_last_known_value_across_chunks(spark):
    from holdspan.operators.meter import asof_total

    readings = spark.createDataFrame([(0, 10, 1.0), (0, 9_000_000, 2.0)], "site_id int, ts bigint, total double")
    probes = spark.createDataFrame([(0, t) for t in (9, 10, 8_999_999, 9_000_000, 50_000_000)], "site_id int, ts bigint")
    got = rows(asof_total(probes, readings), "ts", "total")
    assert got == [(9, None), (10, 1.0), (8_999_999, 1.0), (9_000_000, 2.0), (50_000_000, 2.0)]


def judged_by_loop(changes, readings):
    """Each change against every reading of its sensor."""
    out = set()
    for site, at, step in changes:
        own = [x[1:] for x in readings if x[0] == site]
        before = max((x for x in own if x[0] < at - offset.GRACE), default=None)
        after = [x for x in own if at - offset.GRACE <= x[0] <= at + offset.AFTER_WINDOW]
        if abs(step) < 0.5 or before is None or at - before[0] > offset.BEFORE_WINDOW + offset.GRACE or not after:
            continue
        if before[2] is None:
            out.add((site, at, step, None, "subtracted"))
            continue
        moves = [(abs(v - before[2]), t, i, v - before[2]) for t, i, v in after if v is not None]
        by = max(moves)[3] if moves else None
        verdict = "unmoved" if by is not None and abs(by) < abs(step) / 2 else "added" if by is not None and by * step > 0 else "subtracted"
        out.add((site, at, step, by, verdict))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_moves_against_a_loop(spark, seed):
    """Sparse and dense sensors around a midnight, ties, several readings and changes in a second, no value."""
    rng = random.Random(seed)
    day, readings, changes = 86_400, [], []
    for site, gap in ((0, 1), (1, 40), (2, 400), (3, 2_000)):
        at = -8_000 if site else -800
        while at < (8_000 if site else 800):
            readings += [(site, 20 * day + at, rng.randint(0, 10**9), rng.choice([None, 18.0, 19.0, 19.5, 20.0, 21.0])) for _ in range(rng.choice([1, 1, 3]))]
            at += rng.randint(gap, 2 * gap)
        width = 7_000 if site else 700
        changes += [(site, 20 * day + rng.randint(-width, width), rng.choice([-2.0, -1.0, -0.25, 0.5, 3.0])) for _ in range(60)]
        changes += [(site, rng.choice(readings)[1] + rng.choice([60, -300, 1_860, 0]), 1.0) for _ in range(30)]
    changes += [c[:2] + (-c[2],) for c in changes[::7]] + changes[::5]
    given = spark.createDataFrame(
        [(s, "n", at, 1.0, 1.0 + step) for s, at, step in changes], "site_id int, sensor string, changed_ts bigint, before double, degrees double"
    )
    read = spark.createDataFrame([(s, "n", t, i, v) for s, t, i, v in readings], READING).repartition(3)
    got = offset.judged_changes(given, read).select("site_id", "changed_ts", "step", "moved", "verdict").collect()
    want = judged_by_loop(changes, readings)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 50


def test_moves_are_found_without_pairs(spark, tmp_path):
    """A change and a reading every second: nothing grows with changes times readings."""
    seconds = [(0, "n", t, t, 20.0 + t % 3) for t in range(7_200)]
    spark.createDataFrame(seconds, READING).write.parquet(str(tmp_path / "readings"))
    given = spark.createDataFrame([(0, "n", t, 0.0, 1.0 + t % 2) for t in range(100, 7_200)], "site_id int, sensor string, changed_ts bigint, before double, degrees double")
    got = offset.judged_changes(given, spark.read.parquet(str(tmp_path / "readings")))
    assert got.count() == 7_100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
