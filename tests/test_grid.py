"""Exceedance, evidence, coverage and outages."""

import random

from conftest import rows
from pyspark.sql import functions as F

from holdspan.functions import buckets as B
from holdspan.operators import coverage, grid
from holdspan.options import GridOptions
from holdspan.plans.exceedance import exceedance_report

JUNE = 1_717_200_000  # 2024-06-01 00:00 UTC
DAY, HOUR = 86_400, 3_600


def noon(day, value, hours=1):
    return (JUNE + day * DAY + 12 * HOUR, JUNE + day * DAY + (12 + hours) * HOUR, value)


def test_probabilities_weigh_time_not_readings(spark, samples_of):
    given = samples_of([(JUNE, JUNE + 2700, 100), (JUNE + 2700, JUNE + 3600, 900)])
    cube = grid.with_grouping(grid.exposure_cube(given, "UTC", 100.0), "month")
    axis = grid.fixed_axis(given, 100.0, 1000.0)
    found = {r.bucket: (r.exceedance, r.density) for r in grid.exceedance(grid.exposure_grid(cube, axis), ("facet",), 100.0).collect()}
    assert len(found) == 11 and found[0] == (1.0, 0.0) and found[1] == (1.0, 0.75)
    assert found[2] == (0.25, 0.0) and found[9] == (0.25, 0.25) and found[10] == (0.0, 0.0)


def test_thin_columns_never_qualify_and_the_edge_is_rounded_up(spark, samples_of):
    given = samples_of([noon(d, 500) for d in range(3)] + [noon(d, 500, 2) for d in (4, 5)])
    cube = grid.with_grouping(grid.exposure_cube(given, "UTC", 50.0), "month")
    axis = grid.axis_max(given, 50.0)
    got = grid.reliable_window(cube, axis, 50.0, 120.0, 1.0).first()
    assert (got.threshold, got.earliest, got.latest, got.contiguous) == (150.0, 12, 12, True)
    above = grid.reliable_window(cube, axis, 50.0, 9_000.0, 1.0).first()
    assert (above.threshold, above.earliest) == (500.0, 12)


def test_pooling_unites_days_and_pools_seconds(spark, samples_of):
    given = samples_of([noon(0, 100), noon(40, 300), (JUNE + 12 * HOUR, JUNE + 12 * HOUR + 1800, 100)])
    cube = grid.exposure_cube(given, "UTC", 50.0)
    pooled = [r for r in grid.pooled_columns(cube).collect() if r.hour == 12][0]
    assert (pooled.seconds, pooled.days, pooled.slices, pooled.status) == (9_000, 2, 3, "thin")
    assert grid.pooled_columns(cube).count() == 24
    weekly = exceedance_report(given, "UTC", GridOptions(grouping="week"))["season_columns"]
    monthly = exceedance_report(given, "UTC", GridOptions())["season_columns"]
    assert sorted(weekly.collect()) == sorted(monthly.collect())


def test_axis_is_a_time_weighted_quantile(spark, samples_of):
    rng = random.Random(5)
    at, given = 0, []
    for _ in range(500):
        held = rng.randint(1, 900)
        given.append((at, at + held, rng.choice([-5, 0, rng.uniform(1, 4_000)])))
        at += held
    for q in (0.0, 0.5, 0.9, 0.999, 1.0):
        positive = sorted((v, e - s) for s, e, v in given if v > 0)
        target, running = q * sum(w for _, w in positive), 0
        for v, w in positive:
            running += w
            if running >= target:
                break
        want = max(-(-v // 50), 1) * 50
        assert grid.axis_max(samples_of(given), 50.0, q).first().max_value == want


def test_levels_and_thresholds(spark):
    one = spark.range(1)
    p = [0.0, 0.004, 0.005, 0.5, 1.0]
    got = one.select(*[B.probability_level(F.lit(x)).alias(f"c{i}") for i, x in enumerate(p)]).first()
    assert list(got) == [None, None, 0, 6, 9]
    ticks = one.select(B.nice_thresholds(F.lit(50.0), F.lit(5_000.0)).alias("t")).first().t
    assert ticks == [50.0, 1000.0, 2000.0, 3000.0, 4000.0, 5000.0]
    steps = one.select(*[B.coverage_level(F.lit(a), F.lit(b)).alias(f"c{a}{b}") for a, b in ((0, 30), (1, 30), (30, 30), (4, 0))]).first()
    assert list(steps) == [None, 0, 4, 4]


def test_outages_against_a_plain_loop(spark, samples_of):
    rng = random.Random(9)
    given = []
    for _ in range(300):
        start = rng.randint(0, 60 * DAY)
        given.append((start, start + rng.choice([0, 10, 3_000, 40_000, 5 * DAY if rng.random() < 0.05 else 60]), 1))
    for threshold in (1, 600, 20_000, DAY):
        spans = sorted((s, e) for s, e, _ in given if e > s)
        want, until = [], spans[0][1]
        for s, e in spans[1:]:
            if s - until >= threshold:
                want.append((until, s))
            until = max(until, e)
        assert rows(coverage.outages(samples_of(given), threshold), "start_ts", "end_ts") == want


def test_coverage_counts_the_calendar(spark, samples_of):
    given = samples_of([(JUNE, JUNE + DAY, 1), (JUNE + 3 * DAY, JUNE + 4 * DAY, 1)])
    tables = exceedance_report(given, "UTC", GridOptions())
    got = tables["coverage"].first()
    assert (got.span_days, got.observed_days, got.full_days, got.outages, got.missing_seconds) == (4, 2, 2, 1, 2 * DAY)
    assert got.missing_facets == [] and got.caution and not got.full_year
    year = samples_of([(JUNE, JUNE + HOUR, 1), (JUNE + 400 * DAY, JUNE + 400 * DAY + HOUR, 1)])
    absent = exceedance_report(year, "UTC", GridOptions())["coverage"].first().missing_facets
    assert absent == ["Jan", "Feb", "Mar", "Apr", "May", "Aug", "Sep", "Oct", "Nov", "Dec"]


def test_same_result_for_any_number_of_partitions(spark, samples_of):
    rng = random.Random(1)
    # One series holds most rows.
    hot = samples_of([(JUNE + 700 * i, JUNE + 700 * i + 650, rng.randint(0, 5_000)) for i in range(4_000)])
    given = hot.unionByName(samples_of([noon(d, 300) for d in range(9)], series="b"))
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            tables = exceedance_report(given, "Europe/Berlin", GridOptions(threshold=100.0, probability=0.5))
            seen.append([sorted(map(str, tables[t].collect())) for t in ("windows", "columns", "table", "coverage")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def steps_of(given, step=50.0, top=None):
    cube = grid.with_grouping(grid.exposure_cube(given, "UTC", step), "month")
    axis = grid.axis_from_cube(cube, step, 1.0) if top is None else grid.fixed_axis(given, step, top)
    return grid.exceedance_steps(grid.exposure_grid(cube, axis), ("facet",), step), cube, axis


def test_rows_follow_readings_not_the_length_of_the_axis(spark, samples_of):
    """A value a million times larger changes no number of rows, nor does an axis of 10^11 steps."""
    readings = [noon(d, v) for d in range(6) for v in (0, 75, 100, 420)]
    plain, cube, axis = steps_of(samples_of([*readings, noon(7, 900)]))
    far, far_cube, far_axis = steps_of(samples_of([*readings, noon(7, 900e6)]))
    assert plain.count() == far.count() == 5
    shape = ("exceedance", "density")
    assert rows(plain, *shape) == rows(far, *shape)
    huge, _, _ = steps_of(samples_of(readings), 50.0, 5e12)
    assert huge.agg(F.max("n_buckets")).first()[0] == 10**11 + 1
    assert rows(huge, "first_bucket", "last_bucket")[-1] == (9, 10**11)
    for steps, made, top in ((plain, cube, axis), (far, far_cube, far_axis)):
        seen = grid.all_hours(grid.columns_seen(made), ("facet",))
        assert 2 <= grid.probability_table(steps, seen, top, 50.0).count() <= 20
        assert grid.level_runs(steps).count() >= 1
        asked = grid.probability_at(steps, [100.0, 420.0], 50.0)
        assert rows(asked, "threshold", "exceedance") == [(100.0, 13 / 25), (420.0, 1 / 25)]


def test_steps_written_out_are_dense(spark, samples_of):
    rng = random.Random(3)
    given = samples_of([noon(rng.randrange(40), rng.choice([0, -4, 50, 99.9, 250, 800, 1200])) for _ in range(80)])
    steps, cube, axis = steps_of(given, 50.0, 1000.0)
    dense = grid.exceedance(grid.exposure_grid(cube, axis), ("facet",), 50.0).collect()
    known = steps.collect()
    assert len(dense) == 21 * len({(r.facet, r.hour) for r in dense})
    for r in dense:
        (s,) = [s for s in known if (s.facet, s.hour) == (r.facet, r.hour) and s.first_bucket <= r.bucket <= s.last_bucket]
        assert r.exceedance == s.exceedance and r.density == (s.density if r.bucket == s.last_bucket else 0.0)


def test_the_axis_comes_from_the_cube(spark, samples_of):
    rng = random.Random(9)
    at, given = JUNE, []
    for _ in range(300):
        held = rng.randint(1, 20_000)
        given.append((at, at + held, rng.choice([-5, 0, 50, 100, 3000, 1e9, rng.uniform(1, 4_000)])))
        at += held
    samples = samples_of([*given, (at, at + 9, float("inf")), (at, at, 1e12)])
    cube = grid.exposure_cube(samples, "Europe/Berlin", 50.0)
    for q in (0.0, 0.3, 0.5, 0.9, 0.999, 1.0):
        assert grid.axis_from_cube(cube, 50.0, q).collect() == grid.axis_max(samples, 50.0, q).collect()
    below = samples_of([(JUNE, JUNE + 60, -3), (JUNE, JUNE + 60, 0)])
    assert grid.axis_from_cube(grid.exposure_cube(below, "UTC", 50.0), 50.0).first().n_buckets == 2
