"""What the plans look like, and that hot keys spread."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import all_queries
from checks.fixtures import TZ, Fixtures
from holdspan.operators import intervals as I
from holdspan.operators.settle import settled
from holdspan.options import GridOptions
from holdspan.plans.exceedance import exceedance_report
from holdspan.sources.load import Tables, decide, load_samples

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_query_pairs_everything_or_lacks_a_partition(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # The meter fixture is one running total over the calendar; nothing else goes to one task.
    if "fx_meter" not in ORACLES[key]:
        assert "SinglePartition" not in plan


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landed") / "readings")
    Fixtures(spark, SF).fx_readings.write.parquet(folder)
    return spark.read.parquet(folder)


def test_time_series_and_columns_reach_the_scan(spark, landed):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    given = landed.withColumn("unused", F.lit(1)).filter("series_id = 2")
    plan = plan_of(I.state_samples(given, 900, 1_704_500_000, 1_704_600_000))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts,1.7044991E9)" in plan
    assert "LessThan(ts,1.7046E9)" in plan and "EqualTo(series_id,2)" in plan


def test_one_hot_series_is_spread_by_day(spark, landed):
    plan = plan_of(I.state_samples(landed, 900))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all("_at#" in e or "_chunk#" in e for e in exchanges)


def test_copies_of_readings_change_nothing(spark, landed):
    third = landed.filter("row_id % 3 = 0")
    copied = landed
    for _ in range(4):
        copied = copied.unionByName(third)
    columns = ("site_id", "series_id", "start_ts", "end_ts", "value")
    assert rows(I.state_samples(copied, 900), *columns) == rows(I.state_samples(landed, 900), *columns)


def test_a_settled_cube_gives_the_same_tables(spark, landed, tmp_path):
    samples = I.state_samples(landed, 900)
    plain = exceedance_report(samples, TZ, GridOptions(grouping="week"))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    kept = exceedance_report(samples, TZ, GridOptions(grouping="week"), settle=settled)
    for name in ("windows", "columns", "coverage"):
        assert sorted(map(str, kept[name].collect())) == sorted(map(str, plain[name].collect()))
    assert any(tmp_path.iterdir())


def test_the_report_cuts_samples_once(spark, landed, tmp_path):
    """With a settled cube no table but the record's span and outages reads a sample again."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    tables = exceedance_report(I.state_samples(landed, 900), TZ, GridOptions(), settle=settled)
    for name in ("axis", "probabilities", "windows", "overall_window", "season_windows", "pooled_columns", "season_columns"):
        plan = plan_of(tables[name])
        assert "FileScan" not in plan and "Scan ExistingRDD" in plan, name
    assert "explode(sequence" not in plan_of(tables["table"]) + plan_of(tables["probabilities"])


def test_loading_scans_each_table_once(spark, tmp_path):
    """The decision is settled from ids alone; then each table is read once, for the series it answers for."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    fx, landed = Fixtures(spark, SF), {}
    for name in ("fx_meta", "fx_statistics", "fx_short", "fx_states"):
        getattr(fx, name).write.parquet(str(tmp_path / name))
        landed[name] = spark.read.parquet(str(tmp_path / name))
    asked = landed["fx_meta"].select("site_id", "series_id")
    loaded = load_samples(asked, *landed.values())
    plan = plan_of(loaded.samples)
    assert [plan.count(f"{tmp_path / name}]") for name in landed] == [0, 1, 1, 1]
    assert plan.count("Exchange hashpartitioning") <= 8
    deciding = plan_of(decide(asked, Tables(*landed.values())))
    assert [deciding.count(f"{tmp_path / name}]") for name in landed] == [2, 1, 1, 1]  # meta: what is asked for, and what is known
    reading = [line for line in deciding.splitlines() if "ReadSchema" in line]
    assert reading and not any("mean:" in line or "state:" in line for line in reading)
