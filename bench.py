"""Headline timings: one JSON line.

Single queries run as registered on ``$BENCH_SF_DIR``. The fleet figures repeat the adapters over
many sites (``fleet`` in the output), which is the scale the reports are built for.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from checks import all_queries
from checks.fixtures import TZ, Fixtures
from holdspan.operators import energy, intervals, store
from holdspan.options import GridOptions, StoreOptions
from holdspan.plans.exceedance import exceedance_report
from holdspan.plans.heating import degree_day_report
from holdspan.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FLEET = int(os.environ.get("BENCH_FLEET", "20"))
SINGLE = (
    "state_samples", "hour_slices", "exposure_grid", "exceedance", "reliable_window", "outages",
    "paired_slots", "capacity_sweep", "period_summary", "month_energy", "heat_loss",
    "exceedance_report", "payback_report", "degree_day_report",
)


def fleet_of(df, n: int):
    """The rows for each of ``n`` sites."""
    sites = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("_copy", sites).withColumn("site_id", F.col("_copy") * 10 + F.col("site_id")).drop("_copy")


def landed(df, folder: str):
    """The rows as a table of several files, as a fleet's data would lie."""
    df.repartition(2 * int(CPUS)).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def run(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    registered, _ = all_queries()
    fx = Fixtures(spark, SF_DIR)
    for key in SINGLE[:3]:  # start the session's workers and compile common code
        run(registered[key](spark, SF_DIR))
    times = {key: run(registered[key](spark, SF_DIR)) for key in SINGLE}

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def fleet(df, name: str):
        return landed(fleet_of(df, FLEET), f"{scratch}/{name}")

    readings = fleet(fx.fx_readings, "readings")
    rows = {"fleet_exceedance": readings.count()}
    report = exceedance_report(intervals.state_samples(readings, 900), TZ, GridOptions(grouping="week"))
    times["fleet_exceedance"] = run(report["windows"])

    grid = fleet(fx.fx_grid, "grid")
    rows["fleet_payback"] = grid.count()
    samples = intervals.state_samples(grid, 3_600, keys=("site_id", "role"))
    steps = energy.kept_steps(energy.paired_slots(energy.role_slots(samples), min_coverage=0.6))
    times["fleet_payback"] = run(store.bounded_store(steps, store.size_range(1.0, 20.0, 1.0), StoreOptions()))

    outside, inside, meter = fleet(fx.fx_outside, "outside"), fleet(fx.fx_rooms, "rooms"), fleet(fx.fx_meter, "meter")
    rooms, houses = fleet_of(fx.rooms, FLEET), fleet_of(fx.houses, FLEET)
    rows["fleet_heating"] = outside.count() + inside.count() + meter.count()
    times["fleet_heating"] = run(degree_day_report(outside, inside, meter, rooms, houses, TZ)["causes"])

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "fleet": FLEET,
                "fleet_rows_per_sec": {k: round(n / times[k]) for k, n in rows.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
