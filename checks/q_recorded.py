"""Whole reports from recorder tables: one query for each of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import q_energy, q_grid
from checks.fixtures import TZ, duck
from checks.q_sources import requests
from checks.q_whole import ALL_TIME
from checks.registry import GIVEN, ORACLES, QUERIES, comparable, oracle, r
from holdspan.options import GridOptions, ReadOptions
from holdspan.plans.exceedance import recorded_exceedance
from holdspan.plans.payback import recorded_payback
from holdspan.sources.load import Tables

STEP = q_grid.STEP
READ = ReadOptions(tz=TZ, gap_threshold=30_000)
# Samples of all requested power series, each from the table that answers for it, in place of the grid's.
LOADED = ALL_TIME | {"fx_spans": "select site_id, series_id, row_number() over () as id, start_ts, end_ts, value from loaded_power"}
# A day is full from twenty hours, as reports have it.
FULL = {"summary": q_grid.CTES["summary"].replace("hours >= 6", "hours >= 20")}
# Steps of a rounded axis as multiples of a power of ten, in full: 1, 2, 2.5, 5, 10.
MARKS = {
    "marks": """
    with tops as (select *, (n_buckets - 1) * 50.0::double as top, least(1, n_buckets - 1) * 50.0::double as bottom from axis),
    sized as (select *, power(10.0::double, floor(log10(top / 5))) as unit from tops),
    stepped as (select *, unit * case when top / 5 / unit <= 1 then 1 when top / 5 / unit <= 2 then 2 when top / 5 / unit <= 2.5 then 2.5
                                      when top / 5 / unit <= 5 then 5 else 10 end::double as size from sized),
    found as (select site_id, series_id, n_buckets, bottom as threshold from stepped
              union all
              select site_id, series_id, n_buckets, i * size from stepped, range(12) t(i)
              where i * size <= top and i * size - bottom > (top - bottom) * 0.08::double)
    select site_id, series_id, threshold, least(cast(floor(threshold / 50) as int), n_buckets - 1) as bucket from found"""
}


def tables(fx) -> Tables:
    return Tables(fx.fx_meta, fx.fx_statistics, fx.fx_short, fx.fx_states)


def exceedance(fx):
    options = GridOptions(step=STEP, threshold=420.0, probability=0.85)
    return recorded_exceedance(requests(fx), tables(fx), READ, options)


def reported(name: str, table: str, build, sql: str, recursive: str = "", places: int = 6, other=None) -> None:
    """Register one table of a report as a query."""
    from checks.fixtures import Fixtures

    QUERIES[name] = lambda spark, sf_dir: comparable(build(Fixtures(spark, sf_dir))[table], places)
    ORACLES[name] = oracle(sql, recursive, other)


def given(key: str) -> str:
    return GIVEN[key][1]


def windows(by: str) -> str:
    """Reliable hours per group of ``by``, or over all."""
    g = f"{by} as facet, " if by else ""
    facet = "facet, " if by else ""
    return f"""
    select site_id, series_id, {facet}threshold, earliest, latest, hours, coalesce(hours = latest - earliest + 1, true) as contiguous
    from (select site_id, series_id, {facet}least(ceil(420 / 50.0), n_buckets - 1) * 50.0::double as threshold,
                 min(hour) filter (good) as earliest, max(hour) filter (good) as latest, count(*) filter (good) as hours
          from (select site_id, series_id, {g}hour, n_buckets,
                       count(distinct day) >= 3 and
                       sum(case when bucket >= least(ceil(420 / 50.0), n_buckets - 1) then seconds else 0 end)::double / sum(seconds)
                         >= 0.85::double - 1e-9::double as good
                from placed group by all) q group by all) w"""


MISSING = {
    "missing": """
    select site_id, series_id, facet from (select site_id, series_id, unnest(range(1, 13)) as facet from span where last_day - first_day >= 365) q
    except select site_id, series_id, cast(month(day) as int) from placed"""
}
EXCEEDANCE = {
    "axis": given("axis_max"),
    "probabilities": given("exceedance_steps"),
    "columns": given("facet_columns"),
    "pooled_columns": "select * from facts_all",
    "season_columns": given("season_columns"),
    "windows": windows("month"),
    "overall_window": windows(""),
    "season_windows": windows("half"),
    "never_reaching": f"select * from ({windows('month')}) n where earliest is null",
    "table": given("probability_table"),
    "provenance": given("load_provenance"),
    "refused": given("load_refused"),
}
for name, sql in EXCEEDANCE.items():
    reported(f"recorded_exceedance_{name}", name, exceedance, sql, other=LOADED | MARKS)


def coverage(fx):
    wanted = ("day_fraction", "missing_fraction", "full_year", "sparse", "caution", "full_days", "observed_days")
    found = exceedance(fx)["coverage"].select("site_id", "series_id", *wanted)
    return {"coverage": found}


reported(
    "recorded_exceedance_coverage", "coverage", coverage,
    given("coverage_flags").replace("as caution", "as caution, full_days, observed_days"), other=LOADED | FULL | MISSING,
)

# One import and one export series a site, in W and kW, from hourly statistics and from raw states.
ROLES = {0: "import", 20: "export", 5: "import", 11: "export"}
ROLE_SQL = "case n_nationkey " + " ".join(f"when {k} then '{v}'" for k, v in ROLES.items()) + " end"
PAID = ALL_TIME | {
    "dim_roles": f"""
    select m.site_id, m.series_id, {ROLE_SQL} as role from fx_meta m join nation on n_nationkey = m.metadata_id
    where {ROLE_SQL} is not null""",
    "roles": "select site_id, role, start_ts, end_ts, value from loaded_power join dim_roles using (site_id, series_id)",
}


def payback(fx):
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    roles = fx.fx_meta.select("site_id", "series_id", role[F.col("metadata_id").cast("int")].alias("role")).where("role is not null")
    return recorded_payback(
        roles, tables(fx), q_energy.SIZES, READ, min_coverage=q_energy.COVER, spec=q_energy.SPEC, prices=q_energy.PRICES,
        target_years=q_energy.TARGET,
    )


PAYBACK = {
    "totals": ("pairing_totals", None),
    "sizes": ("price_sizes", ("site_id", "capacity_kwh", "investment", "annual_savings", "payback_years")),
    "best": ("best_size", ("site_id", "capacity_kwh", "payback_years", "next_capacity_kwh", "next_payback_years")),
    "budgets": ("budget", ("site_id", "capacity_kwh", "discount", "budget", "budget_per_kwh", "met")),
    "meeting": ("sizes_meeting_target", None),
    "sensitivity": ("sensitivity_grid", ("site_id", "capacity_kwh", "cost_factor", "price_factor", "payback_years")),
    "calendar": ("paired_calendar", None),
}


def columns(table: str, names):
    return lambda fx: {table: payback(fx)[table].select(*names) if names else payback(fx)[table]}


for name, (key, names) in PAYBACK.items():
    _, sql, recursive, places = GIVEN[key]
    if name == "sizes":
        sql = f"select {', '.join(names)} from ({sql}) p"
    reported(f"recorded_payback_{name}", name, columns(name, names), sql, recursive, places, PAID)
reported(
    "recorded_payback_outages", "outages", payback,
    """
    select site_id, until as start_ts, start_ts as end_ts, start_ts - until as seconds
    from (select site_id, start_ts, lag(start_ts + seconds) over (partition by site_id order by start_ts) as until from steps) q
    where start_ts - until >= 86400""",
    other=PAID,
)
reported(
    "recorded_payback_provenance", "provenance", payback,
    f"select p.* from ({given('load_provenance')}) p join dim_roles using (site_id, series_id)",
    other=PAID | {"requests": "select site_id, series_id from dim_roles"},
)
