"""Recorder files, both layouts, catalogue and sink."""

import sqlite3

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdspan.operators import intervals as I
from holdspan.sources import catalog, normalise, recorder, sink

T0 = 1_718_960_400
MEANS = (1000.0, 2000.0, None, 3000.0)


def modern(path):
    db = sqlite3.connect(path)
    db.execute("create table statistics_meta (id integer primary key, statistic_id text, unit_of_measurement text)")
    db.execute("create table statistics (id integer primary key, metadata_id integer, start_ts float, mean float, min float, max float, state float, sum float)")
    db.execute("create table states_meta (metadata_id integer primary key, entity_id text)")
    db.execute("create table states (state_id integer primary key, metadata_id integer, state text, last_updated_ts float)")
    db.executemany("insert into statistics_meta values (?, ?, ?)", [(1, "sensor.pv", "W"), (2, "sensor.energy", "kWh")])
    db.executemany("insert into statistics values (?, 1, ?, ?, null, null, null, null)", [(i + 1, T0 + 3600 * i, v) for i, v in enumerate(MEANS)])
    db.execute("insert into statistics values (9, 2, ?, null, null, null, 5.0, 5.0)", (T0,))
    db.execute("insert into states_meta values (7, 'sensor.pv')")
    states = ["500", "1500", "unavailable", "2500", "0"]
    db.executemany("insert into states values (?, 7, ?, ?)", [(i + 1, s, T0 + 600 * i + 0.4) for i, s in enumerate(states)])
    db.commit()
    db.close()


def legacy(path):
    db = sqlite3.connect(path)
    db.execute("create table statistics_meta (id integer primary key, statistic_id text, unit_of_measurement text)")
    db.execute("create table statistics (id integer primary key, metadata_id integer, start datetime, mean float, sum float)")
    db.execute("create table states (state_id integer primary key, entity_id text, state text, last_updated datetime)")
    db.execute("insert into statistics_meta values (1, 'sensor.pv', 'W')")
    hours = ["2024-06-21 09:00:00.000000", "2024-06-21 10:00:00", "2024-06-21T11:00:00", "2024-06-21 12:00:00"]
    db.executemany("insert into statistics values (?, 1, ?, ?, null)", [(i + 1, t, v) for i, (t, v) in enumerate(zip(hours, MEANS))])
    states = ["500", "1500", "unavailable", "2500", "0"]
    db.executemany(
        "insert into states values (?, 'sensor.pv', ?, ?)",
        [(i + 1, s, f"2024-06-21 09:{10 * i:02d}:00.400000") for i, s in enumerate(states)],
    )
    db.commit()
    db.close()


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("recorders")
    modern(str(folder / "modern.db"))
    legacy(str(folder / "old one.db"))
    recorder.register(spark)

    def table(name, rows_per_partition=2):
        files = f"{folder}/modern.db,{folder}/old one.db"
        return (
            spark.read.format("recorder").option("files", files).option("table", name)
            .option("rowsPerPartition", rows_per_partition).load()
        )

    return table


def test_both_layouts_give_the_same_samples(spark, read):
    statistics, meta = read("statistics"), read("statistics_meta")
    states, states_meta = read("states"), read("states_meta")
    for site, kept in ((0, True), (1, False)):
        own = [df.filter(F.col("site_id") == site) for df in (statistics, meta, states, states_meta)]
        if not kept:
            own[0] = own[0].drop("start_ts")
            own[2] = own[2].drop("last_updated_ts", "last_changed_ts", "metadata_id")
        named = normalise.normalise_statistics(own[0], own[1]).filter("series_id = 'sensor.pv'")
        got = rows(I.statistics_samples(named), "start_ts", "end_ts", "value")
        assert got == [(T0 + 3600 * i, T0 + 3600 * (i + 1), v) for i, v in enumerate(MEANS) if v is not None]
        entity = normalise.normalise_states(own[2], own[3] if kept else None)
        from holdspan.functions.values import parse_value

        held = I.state_samples(entity.withColumn("value", parse_value(F.col("state"))))
        assert rows(held, "start_ts", "end_ts", "value") == [
            (T0, T0 + 600, 500.0), (T0 + 600, T0 + 1200, 1500.0), (T0 + 1800, T0 + 2400, 2500.0), (T0 + 2400, T0 + 3300, 0.0),
        ]


def test_partitions_and_pushed_filters(spark, read):
    whole = read("statistics")
    assert whole.rdd.getNumPartitions() >= 4
    assert whole.filter("metadata_id = 1 and start_ts >= %d" % (T0 + 3600)).count() == 3
    assert whole.filter("metadata_id in (2, 5)").count() == 1
    assert read("statistics_short_term").count() == 0
    with pytest.raises(Exception):
        read("recorder_runs").count()


def test_a_counter_never_falls_through_to_its_states(spark):
    meta = spark.createDataFrame([(0, 1, "sensor.energy", "kWh")], "site_id int, metadata_id int, series_id string, unit string")
    stats = spark.createDataFrame([(0, 1, 0.0, None, 5.0)], "site_id int, metadata_id int, start_ts double, mean double, sum double")
    states = spark.createDataFrame([(0, "sensor.energy"), (0, "sensor.raw")], "site_id int, series_id string")
    asked = spark.createDataFrame([(0, "sensor.energy"), (0, "sensor.raw"), (0, "sensor.x")], "site_id int, series_id string")
    got = rows(catalog.resolve_source(asked, meta, stats, stats.limit(0), states), "series_id", "source", "known")
    assert got == [("sensor.energy", "statistics", True), ("sensor.raw", "states", True), ("sensor.x", "statistics", False)]
    kinds = catalog.series_kind(catalog.series_catalog(meta, stats)).first()
    assert (kinds.kind, kinds.quantity, kinds.energy_counter, kinds.rank_group) == ("total", None, True, 2)


def test_replacements_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = sorted({"sensor." + "".join(rng.choice("ab_") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    given = [(0, n, "W", rng.randint(1, 30), 1, 0, 0, 0) for n in names]
    columns = "site_id int, series_id string, unit string, rows bigint, means bigint, sums bigint, first_ts bigint, last_ts bigint"
    wanted = ["sensor.ab", "sensor.b_a", "other.x"]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = []
    for w in wanted:
        best = sorted(given, key=lambda g: (-shared(w, g[1]), -g[3], g[1]))[:5]
        want += [(w, place + 1, g[1]) for place, g in enumerate(best)]
    asked = spark.createDataFrame([(0, w) for w in wanted], "site_id int, wanted string")
    got = catalog.suggest_replacements(asked, spark.createDataFrame(given, columns), "power")
    assert rows(got, "wanted", "place", "series_id") == sorted(want)


def test_id_patterns():
    assert catalog.id_patterns("sensor.solar_power") == ["sensor.solar_power", "solar_power", "sensor"]
    assert catalog.id_patterns("a.attic-cellar") == ["a.attic-cellar", "attic-cellar", "cellar"]
    assert catalog.id_patterns("ab") == ["ab"]


def test_tables_are_written_by_bucket_and_month(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 30).alias("site_id"), (F.col("id") * 86_400).alias("start_ts"), "id")
    sink.write_tables({"numbers": df, "plain": df.select("id")}, str(tmp_path), buckets=4)
    again = sink.read_table(spark, str(tmp_path), "numbers")
    assert rows(again, *df.columns) == rows(df, *df.columns)
    assert len([p for p in (tmp_path / "numbers").iterdir() if p.is_dir()]) == 4
    assert sink.read_table(spark, str(tmp_path), "plain").count() == 100
    # A later load of one month leaves the others as they are.
    later = df.filter("start_ts >= 31 * 86400 and start_ts < 59 * 86400").withColumn("id", -F.col("id"))
    sink.write_tables({"numbers": later}, str(tmp_path), buckets=4)
    both = sink.read_table(spark, str(tmp_path), "numbers")
    assert both.count() == 100 and both.filter("id < 0").count() == 28
