"""Queries over slots, pairing, the bounded store and its pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import TZ
from checks.q_grid import local
from checks.registry import part, query, r
from holdspan.operators import coverage, energy, intervals, store
from holdspan.options import Economics, StoreOptions
from holdspan.plans.payback import payback_report

GAP = 3_600
COVER = 0.6
SIZES = (0.5, 1.0, 2.0, 3.5, 5.0, 10.0)
SPEC = StoreOptions(usable_fraction=0.9, round_trip=0.85, max_charge_kw=4.0, max_discharge_kw=5.0)
PRICES = Economics(price_per_kwh=0.35, feed_in_price=0.08, cost_per_kwh=500.0, base_cost=1_500.0)
TARGET = 6.0

part("roles", """
    select site_id, role, s as start_ts, least(coalesce(nxt, s + 3600), s + 3600) as end_ts, value
    from (select *, cast(floor(ts) as bigint) as s,
                 lead(cast(floor(ts) as bigint)) over (partition by site_id, role order by ts, row_id) as nxt from fx_grid) q
    where least(coalesce(nxt, s + 3600), s + 3600) > s""")
part("role_slots", """
    select site_id, role, slot, sum(value * seconds) / 3600000.0::double as kwh, cast(sum(seconds) as bigint) as seconds
    from (select *, least(end_ts, slot + 3600) - greatest(start_ts, slot) as seconds
          from (select *, unnest(generate_series(start_ts // 3600 * 3600, end_ts - 1, 3600)) as slot from roles) a) b
    group by site_id, role, slot""")
part("paired", """
    select coalesce(i.site_id, e.site_id) as site_id, coalesce(i.slot, e.slot) as slot,
           coalesce(i.kwh, 0) as import_kwh, coalesce(e.kwh, 0) as export_kwh,
           least(coalesce(i.seconds, 0), coalesce(e.seconds, 0)) as seconds,
           case when coalesce(i.seconds, 0) >= 2160 and coalesce(e.seconds, 0) >= 2160 then 'kept'
                when coalesce(i.seconds, 0) > 0 and coalesce(e.seconds, 0) > 0 then 'dropped_partial' else 'dropped_unpaired' end as fate
    from (select * from role_slots where role = 'import') i
    full outer join (select * from role_slots where role = 'export') e on i.site_id = e.site_id and i.slot = e.slot""")
part("steps", "select site_id, slot as start_ts, seconds, import_kwh, export_kwh from paired where fate = 'kept'")


def samples(fx):
    return intervals.state_samples(fx.fx_grid, GAP, keys=("site_id", "role"))


def both(fx):
    return energy.role_slots(samples(fx))


def paired(fx):
    return energy.paired_slots(both(fx), min_coverage=COVER)


def steps(fx):
    return energy.kept_steps(paired(fx))


# A slot's energy is a multiple of 1/18,000,000 kWh, which has ties at 6 places but none at 7.
@query("slot_energy", f"select site_id, role, slot, {r('kwh', 7)} as kwh, seconds from role_slots", places=7)
def slot_energy(fx):
    return energy.slot_energy(samples(fx), keys=("site_id", "role"))


@query("common_span", """
    select site_id, min(start_ts) // 3600 * 3600 as origin_ts,
           (max(end_ts) - min(start_ts) // 3600 * 3600 + 3599) // 3600 as slots from roles group by site_id""")
def common_span(fx):
    return energy.common_span(samples(fx))


PAIRED_SQL = f"select site_id, slot, fate, {r('import_kwh', 7)} as import_kwh, {r('export_kwh', 7)} as export_kwh, seconds from paired"


@query("paired_slots", PAIRED_SQL, places=7)
def paired_slots(fx):
    return paired(fx).select("site_id", "slot", "fate", "import_kwh", "export_kwh", "seconds")


@query("paired_slots_join", PAIRED_SQL, places=7)
def paired_slots_join(fx):
    slots = energy.slot_energy(samples(fx), keys=("site_id", "role"))
    sides = [slots.filter(F.col("role") == role).drop("role") for role in ("import", "export")]
    joined = energy.paired_slots(energy.join_slots(*sides), min_coverage=COVER)
    return joined.select("site_id", "slot", "fate", "import_kwh", "export_kwh", "seconds")


part("totals", """
    select site_id, count(*) filter (fate = 'kept') as steps, sum(import_kwh) filter (fate = 'kept') as import_kwh,
           sum(export_kwh) filter (fate = 'kept') as export_kwh, cast(sum(seconds) filter (fate = 'kept') as bigint) as seconds,
           count(*) filter (fate = 'dropped_partial') as dropped_partial,
           count(*) filter (fate = 'dropped_unpaired') as dropped_unpaired
    from paired group by site_id""")


@query("pairing_totals", f"select * replace ({r('import_kwh')} as import_kwh, {r('export_kwh')} as export_kwh) from totals")
def pairing_totals(fx):
    return energy.pairing_totals(paired(fx))


@query("steps_as_samples", f"""
    select site_id, start_ts, start_ts + seconds as end_ts, {r('(import_kwh + export_kwh) * 3600000 / seconds')} as value from steps""")
def steps_as_samples(fx):
    return energy.steps_as_samples(steps(fx))


@query("paired_calendar", """
    select site_id, count(*) as observed_days, count(*) filter (seconds >= 72000) as full_days,
           string_agg(distinct cast(month(day) as varchar), ',') as months
    from (select site_id, cast(""" + local("start_ts") + """ as date) as day, sum(seconds) as seconds from steps group by all) q group by site_id""")
def paired_calendar(fx):
    return coverage.paired_calendar(steps(fx), TZ)


@query("size_range", f"""
    select site_id, {r('0.5 + 0.1::double * i')} as capacity_kwh from (select distinct user_id % 3 as site_id from events) s, range(0, 26) t(i)""")
def size_range(fx):
    sizes = store.size_range(0.5, 3.0, 0.1)
    sites = fx.fx_grid.select("site_id").distinct()
    return sites.select("site_id", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("capacity_kwh"))


ETA = "sqrt(0.85::double)"
REPLAY = f"""
    replay as (
      select site_id, cap, usable, 0::bigint as n, 0::double as soc, 0::double as drawn, 0::double as filled, 0::double as peak from caps
      union all
      select site_id, cap, usable, n, after_draw + into_it * {ETA}, drawn + out_of, filled + into_it, greatest(peak, after_draw + into_it * {ETA})
      from (select *, greatest(least(export_kwh, (usable - after_draw) / {ETA}, 4.0::double * hours), 0) as into_it
            from (select *, soc - out_of / {ETA} as after_draw
                  from (select p.site_id, p.cap, p.usable, s.n, p.soc, p.drawn, p.filled, p.peak, s.export_kwh, s.hours,
                               greatest(least(s.import_kwh, p.soc * {ETA}, 5.0::double * s.hours), 0) as out_of
                        from replay p join numbered s on s.site_id = p.site_id and s.n = p.n + 1) a) b) c)"""
part("numbered", """
    select site_id, row_number() over (partition by site_id order by start_ts) as n, seconds / 3600.0::double as hours, import_kwh, export_kwh from steps""")
part("caps", "select site_id, cap, cap * 0.9::double as usable from (select distinct site_id from steps) s, (values "
     + ", ".join(f"({s}::double)" for s in SIZES) + ") v(cap)")
# The last row of each replay.
STORE = """(select site_id, cap as capacity_kwh, usable, drawn, filled, peak, soc from
            (select *, row_number() over (partition by site_id, cap order by n desc) as k from replay) z where k = 1)"""
PRICED = f"""(select *, investment - lag(investment, 1, 0) over w as more, annual - lag(annual, 1, 0) over w as gain
    from (select s.*, t.import_kwh, 365.2425::double * 86400 / t.seconds as yearly, 1500 + 500.0::double * capacity_kwh as investment,
             drawn * 0.35::double - filled * 0.08::double as observed,
             (drawn * 0.35::double - filled * 0.08::double) * 365.2425::double * 86400 / t.seconds as annual,
             case when drawn * 0.35::double - filled * 0.08::double > 0
               then (1500 + 500.0::double * capacity_kwh) / ((drawn * 0.35::double - filled * 0.08::double) * 365.2425::double * 86400 / t.seconds) end as years
      from {STORE} s join totals t using (site_id)) q window w as (partition by site_id order by capacity_kwh))"""

def stores(fx):
    return store.bounded_store(steps(fx), SIZES, SPEC)


def priced(fx):
    return store.price_sizes(stores(fx), energy.pairing_totals(paired(fx)), PRICES)


@query("bounded_store", f"""
    select site_id, capacity_kwh, {r('drawn')} as avoided_import_kwh, {r('filled')} as lost_export_kwh, {r('peak')} as peak_kwh,
           {r('soc')} as final_kwh, {r('drawn / usable')} as full_cycles from {STORE} z where capacity_kwh = 2.0""", recursive=REPLAY)
def bounded_store(fx):
    return store.bounded_store(steps(fx), (2.0,), SPEC, block=5 * 86_400)


@query("capacity_sweep", f"""
    select site_id, capacity_kwh, {r('drawn')} as avoided_import_kwh, {r('filled')} as lost_export_kwh, {r('peak')} as peak_kwh,
           {r('soc')} as final_kwh, {r('drawn / usable')} as full_cycles from {STORE} z""", recursive=REPLAY)
def capacity_sweep(fx):
    return stores(fx)


@query("price_sizes", f"""
    select site_id, capacity_kwh, {r('yearly')} as annualisation, investment, {r('observed')} as observed_savings,
           {r('annual')} as annual_savings, {r('years')} as payback_years, {r('drawn / import_kwh')} as import_reduction,
           {r('drawn / usable * yearly')} as cycles_per_year, {r('greatest(filled - drawn, 0)')} as losses_kwh
    from {PRICED} z""", recursive=REPLAY)
def price_sizes(fx):
    return priced(fx).drop("avoided_import_kwh", "lost_export_kwh", "peak_kwh", "final_kwh", "full_cycles")


@query("marginal_payback", f"""
    select site_id, capacity_kwh, {r('case when gain > 0 then more / gain end')} as marginal_payback_years from {PRICED} z""", recursive=REPLAY)
def marginal_payback(fx):
    return store.marginal_payback(priced(fx)).select("site_id", "capacity_kwh", "marginal_payback_years")


BEST = f"""(select * from (select *, lead(capacity_kwh) over w as next_capacity_kwh, lead(years) over w as next_years,
      row_number() over (partition by site_id order by years nulls last, capacity_kwh) as k
      from {PRICED} y window w as (partition by site_id order by capacity_kwh)) x where k = 1 and years is not null)"""


@query("best_size", f"""
    select site_id, capacity_kwh, {r('years')} as payback_years, next_capacity_kwh, {r('next_years')} as next_payback_years from {BEST} z""", recursive=REPLAY)
def best_size(fx):
    names = ("site_id", "capacity_kwh", "payback_years", "next_capacity_kwh", "next_payback_years")
    return store.best_size(priced(fx)).select(*names)


BUDGET = f"(select *, greatest(annual, 0) * 6 as budget, coalesce(years <= 6, false) as met from {PRICED} y)"


@query("budget", f"""
    select site_id, capacity_kwh, {r('budget')} as budget, {r('case when budget > 1500 then (budget - 1500) / capacity_kwh end')} as budget_per_kwh,
           {r('case when investment > budget then 1 - budget / investment end')} as discount, met from {BUDGET} z""", recursive=REPLAY)
def budget(fx):
    names = ("site_id", "capacity_kwh", "budget", "budget_per_kwh", "discount", "met")
    return store.budget(priced(fx), TARGET, PRICES).select(*names)


@query("sensitivity_grid", f"""
    select site_id, capacity_kwh, pf as price_factor, cf as cost_factor,
           {r('case when drawn * 0.35 * pf - filled * 0.08 > 0 then investment * cf / ((drawn * 0.35::double * pf - filled * 0.08::double) * yearly) end')} as payback_years
    from {BEST} z, (values (0.75::double), (1.0::double), (1.25::double)) a(pf), (values (0.75::double), (1.0::double), (1.25::double)) b(cf)""", recursive=REPLAY)
def sensitivity_grid(fx):
    names = ("site_id", "capacity_kwh", "price_factor", "cost_factor", "payback_years")
    return store.sensitivity_grid(store.best_size(priced(fx)), 0.25, PRICES).select(*names)


@query("sizes_meeting_target", f"""
    select site_id, count(*) filter (met) as meeting,
           (array_agg(capacity_kwh order by investment, capacity_kwh) filter (met))[1] as cheapest_kwh,
           (array_agg(capacity_kwh order by years, capacity_kwh) filter (years is not null))[1] as closest_kwh
    from {BUDGET} z group by site_id""", recursive=REPLAY)
def sizes_meeting_target(fx):
    return store.sizes_meeting_target(store.budget(priced(fx), TARGET, PRICES))


@query("payback_report", f"""
    select site_id, capacity_kwh, {r('years')} as payback_years, {r('case when gain > 0 then more / gain end')} as marginal_payback_years,
           {r('annual')} as annual_savings from {PRICED} z""", recursive=REPLAY)
def report(fx):
    tables = payback_report(samples(fx), SIZES, TZ, min_coverage=COVER, spec=SPEC, prices=PRICES, target_years=TARGET)
    return tables["sizes"].select("site_id", "capacity_kwh", "payback_years", "marginal_payback_years", "annual_savings")
