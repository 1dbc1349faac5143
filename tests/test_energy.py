"""Slots, pairing, the bounded store against a plain loop, and what pays back."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdspan.operators import energy, store
from holdspan.options import Economics, StoreOptions

STEP = "site_id bigint, start_ts bigint, seconds bigint, import_kwh double, export_kwh double"


def replay(steps, capacity, spec):
    """One store, step by step."""
    usable, eta = capacity * spec.usable_fraction, math.sqrt(spec.round_trip)
    soc = drawn = filled = peak = 0.0
    if usable <= 0 or eta <= 0:
        return 0.0, 0.0, 0.0, 0.0
    for _, _, seconds, need, spare in steps:
        hours = seconds / 3600
        limit = math.inf if spec.max_discharge_kw is None else spec.max_discharge_kw * hours
        out = max(min(need, soc * eta, limit), 0)
        soc -= out / eta
        limit = math.inf if spec.max_charge_kw is None else spec.max_charge_kw * hours
        into = max(min(spare, (usable - soc) / eta, limit), 0)
        soc += into * eta
        drawn, filled, peak = drawn + out, filled + into, max(peak, soc)
    return drawn, filled, peak, soc


@pytest.mark.parametrize(
    "spec", [StoreOptions(), StoreOptions(1.0, 0.6, 0.8, 1.1), StoreOptions(0.9, 1.0), StoreOptions(0.9, 0.0)]
)
def test_blocks_replay_like_one_sequence(spark, spec):
    rng = random.Random(3)
    sites = {
        site: [(site, 3600 * i, rng.choice([3600, 3300]), rng.expovariate(1), rng.expovariate(0.9)) for i in range(n)]
        for site, n in ((0, 1500), (1, 40))
    }
    given = spark.createDataFrame([s for steps in sites.values() for s in steps], STEP)
    sizes = (0.5, 2.0, 7.0, 40.0)
    for block in (store.BLOCK, 86_400, 137 * 3600):
        got = {
            (r.site_id, r.capacity_kwh): (r.avoided_import_kwh, r.lost_export_kwh, r.peak_kwh, r.final_kwh)
            for r in store.bounded_store(given, sizes, spec, block=block).collect()
        }
        assert len(got) == 8
        for (site, size), values in got.items():
            assert values == pytest.approx(replay(sites[site], size, spec), abs=1e-9)


def test_draw_comes_before_fill_inside_a_step(spark):
    given = spark.createDataFrame([(0, 0, 3600, 1.0, 1.0), (0, 3600, 3600, 1.0, 0.0)], STEP)
    got = store.bounded_store(given, (10.0,), StoreOptions(1.0, 1.0)).first()
    assert (got.avoided_import_kwh, got.lost_export_kwh, got.peak_kwh, got.final_kwh) == (1.0, 1.0, 1.0, 0.0)


def test_slots_add_up_whatever_their_length(spark, samples_of):
    rng = random.Random(2)
    at, given = 1_000_000, []
    for _ in range(300):
        held = rng.randint(1, 4_000)
        given.append((at, at + held, rng.randint(0, 3_000)))
        at += held + rng.choice([0, 0, 50])
    total = sum((e - s) * v for s, e, v in given) / 3.6e6
    for width in (300, 900, 3_600):
        slots = energy.slot_energy(samples_of(given), width)
        kwh, seconds = slots.agg(F.sum("kwh"), F.sum("seconds")).first()
        assert kwh == pytest.approx(total) and seconds == sum(e - s for s, e, _ in given)


def test_pairing_drops_thin_and_lonely_slots(spark):
    def side(role, slots):
        return [(0, role, s * 3600, s * 3600 + held, float(w)) for s, held, w in slots]

    given = spark.createDataFrame(
        side("import", [(0, 3600, 1000), (1, 3300, 500), (2, 600, 10), (3, 3600, 1), (5, 3600, 2)])
        + side("export", [(0, 3600, 2000), (1, 3600, 100), (2, 3600, 10), (4, 3600, 1)]),
        "site_id bigint, role string, start_ts bigint, end_ts bigint, value double",
    )
    both = energy.role_slots(given)
    paired = energy.paired_slots(both)
    total = energy.pairing_totals(paired).first()
    assert (total.steps, total.dropped_partial, total.dropped_unpaired, total.seconds) == (2, 1, 3, 6_900)
    assert total.import_kwh == pytest.approx(1 + 500 * 3300 / 3.6e6)
    slots = [energy.slot_energy(given.filter(F.col("role") == r).drop("role"), keys=("site_id",)) for r in ("import", "export")]
    joined = energy.paired_slots(energy.join_slots(*slots))
    columns = ("slot", "fate", "import_kwh", "export_kwh", "seconds")
    assert rows(joined, *columns) == rows(paired, *columns)


def test_totals_without_a_kept_slot_are_null(spark):
    """No energy was measured together, which is not an energy of nought."""
    given = spark.createDataFrame(
        [(7, "import", 0, 3600, 10.0)], "site_id bigint, role string, start_ts bigint, end_ts bigint, value double"
    )
    total = energy.pairing_totals(energy.paired_slots(energy.role_slots(given))).first()
    assert (total.steps, total.dropped_partial, total.dropped_unpaired) == (0, 0, 1)
    assert (total.import_kwh, total.export_kwh, total.seconds) == (None, None, None)


@pytest.fixture(scope="module")
def priced(spark):
    rng = random.Random(8)
    steps = [(0, 3600 * i, 3600, rng.expovariate(1), rng.expovariate(1)) for i in range(400)]
    given = spark.createDataFrame(steps, STEP)
    totals = given.groupBy("site_id").agg(F.sum("import_kwh").alias("import_kwh"), F.sum("seconds").alias("seconds"))
    stores = store.bounded_store(given, (1.0, 2.0, 4.0, 8.0)).persist()
    return lambda **prices: store.price_sizes(stores, totals, Economics(**prices))


def test_twice_the_price_halves_the_payback(priced):
    one = rows(priced(price_per_kwh=0.3), "capacity_kwh", "payback_years")
    two = rows(priced(price_per_kwh=0.6), "capacity_kwh", "payback_years")
    assert [y / 2 for _, y in one] == pytest.approx([y for _, y in two])


def test_a_budget_hits_its_target(priced):
    prices = Economics()
    budgets = store.budget(priced(), 5.0, prices).collect()
    for b in budgets:
        assert b.budget / b.annual_savings == pytest.approx(5.0)
        assert b.met == (b.payback_years <= 5.0) and (b.discount is None) == (b.investment <= b.budget)
    best = store.best_size(priced()).first()
    assert best.payback_years == min(b.payback_years for b in budgets)
    grid = store.sensitivity_grid(store.best_size(priced()), 0.25, prices).collect()
    assert len(grid) == 9
    same = [g.payback_years for g in grid if g.price_factor == 1.0 and g.cost_factor == 1.0]
    assert same == pytest.approx([best.payback_years])


def test_nothing_saved_is_never_paid_back(priced):
    got = priced(price_per_kwh=0.0).collect()
    assert all(r.payback_years is None for r in got)
    assert store.best_size(priced(price_per_kwh=0.0)).count() == 0


def test_size_ranges():
    assert store.size_range(0.0, 1.0, 0.25) == [0.25, 0.5, 0.75, 1.0]
    assert store.size_range(2.0, 1.0, 1.0) == [] and store.exact_sizes([3, 1, 3]) == [1.0, 3.0]
    with pytest.raises(ValueError):
        store.exact_sizes([0.0])
