"""Queries over intervals, calendars, the probability grid and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import TZ
from checks.registry import CTES, part, query, r
from holdspan.functions import buckets as B
from holdspan.functions import calendar as C
from holdspan.operators import coverage, grid, intervals
from holdspan.options import GridOptions
from holdspan.plans.exceedance import exceedance_report

STEP = 50.0
KEYS = ("site_id", "series_id")
JAN = 1704067200  # 2024-01-01 UTC


def local(ts: str) -> str:
    return f"timezone('{TZ}', to_timestamp({ts}))"


def utc(local_ts: str) -> str:
    return f"cast(epoch(timezone('{TZ}', cast({local_ts} as timestamp))) as bigint)"


# ---- intervals -------------------------------------------------------------------------------
part("held", """
    select site_id, series_id, s as start_ts, least(coalesce(nxt, s + 900), s + 900) as end_ts, value
    from (select *, cast(floor(ts) as bigint) as s,
                 lead(cast(floor(ts) as bigint)) over (partition by site_id, series_id order by ts, row_id) as nxt
          from fx_readings) q
    where value is not null and least(coalesce(nxt, s + 900), s + 900) > s""")
part("slices", f"""
    select *, cast({local('piece_start')} as date) as day, cast(extract(hour from {local('piece_start')}) as int) as hour,
           piece_end - piece_start as seconds
    from (select site_id, series_id, id, value, greatest(start_ts, h) as piece_start, least(end_ts, h + 3600) as piece_end
          from (select *, unnest(generate_series(start_ts - start_ts % 3600, end_ts - 1, 3600)) as h from fx_spans) q) p""")


@query("state_samples", f"select site_id, series_id, start_ts, end_ts, {r('value')} as value from held")
def state_samples(fx):
    return intervals.state_samples(fx.fx_readings, 900)


@query("state_samples_window", f"""
    select site_id, series_id, greatest(start_ts, {JAN + 86400}) as start_ts, least(end_ts, {JAN + 9 * 86400 + 777}) as end_ts,
           {r('value')} as value
    from held where least(end_ts, {JAN + 9 * 86400 + 777}) > greatest(start_ts, {JAN + 86400})""")
def state_samples_window(fx):
    return intervals.state_samples(fx.fx_readings, 900, JAN + 86400, JAN + 9 * 86400 + 777)


@query("clip", """
    select site_id, series_id, id, greatest(start_ts, 852076800) as start_ts, least(end_ts, 900000000) as end_ts
    from fx_spans where least(end_ts, 900000000) > greatest(start_ts, 852076800)""")
def clip(fx):
    return intervals.clip(fx.fx_spans.drop("value"), 852076800, 900000000)


@query("hour_slices", """
    select site_id, series_id, id, piece_start as start_ts, piece_end as end_ts, seconds,
           cast(day as varchar) as day, hour from slices""")
def hour_slices(fx):
    return intervals.hour_slices(fx.fx_spans.drop("value"), TZ)


@query("slot_slices", """
    select site_id, series_id, id, greatest(start_ts, slot) as start_ts, least(end_ts, slot + 900) as end_ts,
           least(end_ts, slot + 900) - greatest(start_ts, slot) as seconds, slot
    from (select *, unnest(generate_series(start_ts // 900 * 900, end_ts - 1, 900)) as slot from fx_spans) q""")
def slot_slices(fx):
    return intervals.slot_slices(fx.fx_spans.drop("value"), 900)


@query("utc_hour_slices", """
    select site_id, series_id, h as slot, cast(sum(least(end_ts, h + 3600) - greatest(start_ts, h)) as bigint) as seconds
    from (select *, unnest(generate_series(start_ts // 3600 * 3600, end_ts - 1, 3600)) as h from fx_spans) q
    group by all""")
def utc_hour_slices(fx):
    cut = intervals.slot_slices(fx.fx_spans, 3600)
    return cut.groupBy(*KEYS, "slot").agg(F.sum("seconds").alias("seconds"))


@query("day_slices", """
    select site_id, series_id, cast(day as varchar) as day, cast(sum(seconds) as bigint) as seconds
    from slices group by site_id, series_id, day""")
def day_slices(fx):
    cut = intervals.day_slices(fx.fx_spans, TZ)
    return cut.groupBy(*KEYS, "day").agg(F.sum("seconds").alias("seconds"))


@query("changes_only", """
    select site_id, series_id, row_id, floor(value / 2000) as value
    from (select *, lag(floor(value / 2000)) over (partition by site_id, series_id order by ts, row_id) as before,
                 row_number() over (partition by site_id, series_id order by ts, row_id) as n
          from fx_readings) q
    where n = 1 or before is distinct from floor(value / 2000)""")
def changes_only(fx):
    rows = fx.fx_readings.withColumn("value", F.floor(F.col("value") / 2000).cast("double"))
    return intervals.changes_only(rows).drop("ts")


# ---- scalars ---------------------------------------------------------------------------------
@query("bucket_index", """
    select row_id, value, cast(case when value <= 0 then 0 when value > 0 then least(floor(value / 50), 60) end as bigint) as bucket
    from (select row_id, round(value - 200, 6) as value from fx_readings) q""")
def bucket_index(fx):
    rows = fx.fx_readings.select("row_id", F.round(F.col("value") - 200, 6).alias("value"))
    return rows.withColumn("bucket", B.bucket_index(F.col("value"), STEP, F.lit(61)))


@query("bucket_at_least", """
    select row_id, value, cast(case when value <= 0 then 0 when value > 0 then least(ceil(value / 50), 60) end as bigint) as bucket
    from (select row_id, round(value - 200, 6) as value from fx_readings) q""")
def bucket_at_least(fx):
    rows = fx.fx_readings.select("row_id", F.round(F.col("value") - 200, 6).alias("value"))
    return rows.withColumn("bucket", B.bucket_at_least(F.col("value"), STEP, F.lit(61)))


@query("probability_level", """
    select row_id, case when p > 0 and p >= 0.005 then cast(least(floor(power(least(p, 1), 0.6) * 10), 9) as int) end as level
    from (select row_id, value / 9000.0::double as p from fx_readings) q""")
def probability_level(fx):
    p = F.col("value") / 9000.0
    return fx.fx_readings.select("row_id", B.probability_level(p).alias("level"))


@query("level_edges", f"""
    select levels, i, {r('power(i / levels::double, 1 / 0.6::double)')} as edge
    from (select distinct 3 + user_id % 14 as levels from events) l, range(16) t(i) where i < levels""")
def level_edges(fx):
    sizes = fx.table("events").select((F.lit(3) + F.col("user_id") % 14).alias("levels")).distinct()
    edges = F.lit(None)
    for n in range(3, 17):
        edges = F.when(F.col("levels") == n, B.level_edges(n)).otherwise(edges)
    return sizes.select("levels", F.posexplode(edges).alias("i", "edge"))


@query("coverage_level", """
    select id, case when a > 0 then cast(case when b = 0 then 4 else greatest(ceil(least(a / b::double, 1) * 5), 1) - 1 end as int) end as step
    from (select o_orderkey as id, o_custkey % 32 as a, o_orderkey % 31 as b from orders) q""")
def coverage_level(fx):
    a, b = F.col("o_custkey") % 32, F.col("o_orderkey") % 31
    return fx.table("orders").select(F.col("o_orderkey").alias("id"), B.coverage_level(a, b).alias("step"))


part("tops", "select distinct (1 + o_orderkey % 97) * 50.0::double as top from orders")
part("steps_of", """
    select top, mag * case when rough / mag <= 1 then 1 when rough / mag <= 2 then 2
                           when rough / mag <= 2.5 then 2.5 when rough / mag <= 5 then 5 else 10 end as step
    from (select top, top / 5 as rough, power(10::double, floor(log10(top / 5))) as mag from tops) q""")


@query("nice_thresholds", f"""
    select top, threshold from (
      select {r('top')} as top, {r('step * i')} as threshold
      from steps_of, range(12) t(i) where step * i <= top and step * i - 50 > (top - 50) * 0.08
      union all select {r('top')}, 50.0::double from tops) q""")
def nice_thresholds(fx):
    tops = fx.table("orders").select(((1 + F.col("o_orderkey") % 97) * 50.0).alias("top")).distinct()
    return tops.select("top", F.explode(B.nice_thresholds(F.lit(50.0), F.col("top"))).alias("threshold"))


@query("period_labels", """
    select distinct cast(d as varchar) as day, strftime(d, '%B') as month, 'Week ' || lpad(cast(week(d) as varchar), 2, '0') as week,
           season || '/' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as season,
           strftime(d, '%B %Y') as month_period,
           'Week ' || lpad(cast(week(d) as varchar), 2, '0') || ', ' || isoyear(d) as week_period
    from (select cast(o_orderdate as date) as d, year(o_orderdate) - cast(month(o_orderdate) < 7 as int) as season from orders) q""")
def period_labels(fx):
    day = F.col("day")
    days = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        "day",
        C.facet_label(F.month(day), "month").alias("month"),
        C.facet_label(F.weekofyear(day), "week").alias("week"),
        C.season_label(C.heating_season(day)).alias("season"),
        C.period_label(F.lit("month"), F.year(day), F.month(day)).alias("month_period"),
        C.period_label(F.lit("week"), C.iso_year(day), F.weekofyear(day)).alias("week_period"),
    )


# ---- calendar --------------------------------------------------------------------------------
@query("local_parts", f"""
    select id, cast(cast(l as date) as varchar) as day, cast(hour(l) as int) as hour, cast(month(l) as int) as month,
           cast(week(l) as int) as iso_week, cast(isoyear(l) as int) as iso_year, cast(year(l) as int) as year
    from (select id, {local('start_ts')} as l from fx_spans) q""")
def local_parts(fx):
    parts = C.local_parts(F.col("start_ts"), TZ)
    return fx.fx_spans.select("id", *[c.alias(n) for n, c in parts.items()])


part("days", "select distinct cast(o_orderdate as date) as d from orders")


@query("local_midnight", f"select cast(d as varchar) as day, {utc('d')} as midnight from days")
def local_midnight(fx):
    days = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("midnight", C.midnight(F.col("day"), TZ))


@query("day_length", f"select cast(d as varchar) as day, {utc('d + 1')} - {utc('d')} as seconds from days")
def day_length(fx):
    days = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("seconds", C.day_length(F.col("day"), TZ))


@query("month_hours_total", f"""
    select cast(m as varchar) as month, cast(({utc('m + interval 1 month')} - {utc('m')}) / 3600 as int) as hours
    from (select distinct cast(date_trunc('month', d) as date) as m from days) q""")
def month_hours_total(fx):
    month = C.month_start(F.col("o_orderdate").cast("date"))
    months = fx.table("orders").select(month.alias("month")).distinct()
    return months.withColumn("hours", C.month_hours(F.col("month"), TZ))


@query("facet_of", """
    select site_id, series_id, id, cast(month(l) as int) as month, cast(week(l) as int) as week
    from (select *, """ + local("start_ts") + """ as l from fx_spans) q""")
def facet_of(fx):
    day = C.local_day(F.col("start_ts"), TZ)
    return fx.fx_spans.select(
        *KEYS, "id", C.facet_of(day, "month").alias("month"), C.facet_of(day, "week").alias("week")
    )


@query("period_of", """
    select grain, year, part, count(*) as days from (
      select 'month' as grain, cast(year(d) as int) as year, cast(month(d) as int) as part from days
      union all select 'week', cast(isoyear(d) as int), cast(week(d) as int) from days
      union all select 'year', cast(year(d) as int), null from days
      union all select 'record', null, null from days) q group by all""")
def period_of(fx):
    day = F.col("o_orderdate").cast("date")
    days = fx.table("orders").select(day.alias("day")).distinct()
    spread = days.select(F.explode(C.periods_of(F.col("day"))).alias("p")).select("p.*")
    return spread.groupBy("grain", "year", "part").agg(F.count(F.lit(1)).alias("days"))


@query("heating_season", """
    select cast(d as varchar) as day, cast(case when month(d) >= 7 then year(d) else year(d) - 1 end as int) as season from days""")
def heating_season(fx):
    days = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("season", C.heating_season(F.col("day")))


@query("half_year", """
    select cast(d as varchar) as day, case when month(d) in (4,5,6,7,8,9) then 'summer' else 'winter' end as half from days""")
def half_year(fx):
    days = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("half", C.half_year(F.month("day")))


# ---- probability grid ------------------------------------------------------------------------
part("axis", """
    select site_id, series_id, s * 50.0::double as max_value, cast(s + 1 as int) as n_buckets
    from (select site_id, series_id, greatest(ceil(min(value) filter (running >= 0.999::double * total) / 50), 1) as s
          from (select *, sum(w) over (partition by site_id, series_id order by value) as running,
                       sum(w) over (partition by site_id, series_id) as total
                from (select site_id, series_id, value, end_ts - start_ts as w from fx_spans where value > 0) a) b
          group by site_id, series_id) c""")
part("placed", """
    select site_id, series_id, day, hour, seconds, n_buckets, cast(month(day) as int) as month, cast(week(day) as int) as week,
           case when month(day) between 4 and 9 then 'summer' else 'winter' end as half,
           cast(case when value <= 0 then 0 else least(floor(value / 50), n_buckets - 1) end as int) as bucket
    from slices join axis using (site_id, series_id)""")


def column_part(by: str | None) -> str:
    """Per group, hour and dense bucket: seconds and tail."""
    g = f"{by} as facet, " if by else ""
    gg = "facet, " if by else ""
    return f"""
    select site_id, series_id, {gg}hour, bucket, n_buckets,
           cast(sum(sec) over (partition by site_id, series_id, {gg}hour order by bucket desc) as double)
             / sum(sec) over (partition by site_id, series_id, {gg}hour) as exceedance,
           cast(sec as double) / sum(sec) over (partition by site_id, series_id, {gg}hour) as density
    from (select c.*, b.bucket, coalesce(s.sec, 0) as sec
          from (select distinct site_id, series_id, {g}hour, n_buckets from placed) c
          cross join lateral (select unnest(range(c.n_buckets)) as bucket) b
          left join (select site_id, series_id, {g}hour, bucket, sum(seconds) as sec from placed group by all) s
            using (site_id, series_id, {gg}hour, bucket)) d"""


part("dense_month", column_part("month"))
part("dense_all", column_part(None))


def facts_part(by: str | None) -> str:
    g = f"{by} as facet, " if by else ""
    gg = "facet, " if by else ""
    return f"""
    select *, case when days = 0 then 'empty' when days < 3 then 'thin' else 'sufficient' end as status
    from (select site_id, series_id, {gg}h as hour, cast(coalesce(sec, 0) as bigint) as seconds,
                 coalesce(n, 0) as slices, coalesce(days, 0) as days
          from (select distinct site_id, series_id{', ' + by + ' as facet' if by else ''} from placed) f
          cross join (select cast(range as int) as h from range(24)) hh
          left join (select site_id, series_id, {g}hour as h, sum(seconds) as sec, count(*) as n, count(distinct day) as days
                     from placed group by all) s using (site_id, series_id, {gg}h)) q"""


part("facts_month", facts_part("month"))
part("facts_all", facts_part(None))
part("facts_half", facts_part("half"))
part("span", f"""
    select site_id, series_id, min(start_ts) as first_ts, max(end_ts) as last_ts,
           cast(sum(end_ts - start_ts) as bigint) as observed_seconds,
           cast({local('min(start_ts)')} as date) as first_day, cast({local('max(end_ts) - 1')} as date) as last_day
    from fx_spans group by site_id, series_id""")
part("possible", """
    select site_id, series_id, cast(month(day) as int) as facet, count(*) as possible_days
    from (select site_id, series_id, unnest(generate_series(first_day, last_day, interval 1 day)) as day from span) q group by all""")


def cube(fx):
    return grid.exposure_cube(fx.fx_spans, TZ, STEP)


@query("axis_max", f"select site_id, series_id, {r('max_value')} as max_value, n_buckets from axis")
def axis_max(fx):
    return grid.axis_max(fx.fx_spans, STEP)


@query("exposure_grid", """
    select site_id, series_id, month as facet, hour, bucket, cast(sum(seconds) as bigint) as seconds, count(*) as slices, n_buckets
    from placed group by all""")
def exposure_grid(fx):
    c = cube(fx)
    return grid.exposure_grid(grid.with_grouping(c, "month"), grid.axis_max(fx.fx_spans, STEP))


@query("evidence_days", """
    select site_id, series_id, month as facet, hour, count(distinct day) as days from placed group by all
    union all select site_id, series_id, month, null, count(distinct day) from placed group by all
    union all select site_id, series_id, null, null, count(distinct day) from placed group by all""")
def evidence_days(fx):
    return grid.evidence_days(cube(fx), "month")


@query("full_days_by_hours", """
    select site_id, series_id, count(*) as observed_days, count(*) filter (hours >= 6) as full_days
    from (select site_id, series_id, day, count(distinct hour) as hours from placed group by all) q group by all""")
def full_days_by_hours(fx):
    return grid.full_days(cube(fx), 6)


def probabilities(fx, by="month"):
    c = cube(fx)
    axis = grid.axis_max(fx.fx_spans, STEP)
    if by is None:
        return grid.exceedance(grid.exposure_grid(c, axis, ()), (), STEP)
    return grid.exceedance(grid.exposure_grid(grid.with_grouping(c, by), axis), ("facet",), STEP)


def steps(fx):
    c = grid.with_grouping(cube(fx), "month")
    return grid.exceedance_steps(grid.exposure_grid(c, grid.axis_from_cube(c, STEP)), ("facet",), STEP)


part("step_rows", """
    select site_id, series_id, facet, hour, n_buckets, exceedance, max(density) as density,
           min(bucket) as first_bucket, max(bucket) as last_bucket
    from (select *, coalesce(sum(case when density > 0 then 1 else 0 end) over (
                 partition by site_id, series_id, facet, hour order by bucket rows between unbounded preceding and 1 preceding), 0) as run
          from dense_month) q
    group by site_id, series_id, facet, hour, n_buckets, exceedance, run""")


@query("exceedance_steps", f"""
    select site_id, series_id, facet, hour, n_buckets, first_bucket, last_bucket, first_bucket * 50.0::double as first_edge,
           {r('exceedance')} as exceedance, {r('density')} as density from step_rows""")
def exceedance_steps(fx):
    return steps(fx)


# Within the axis, on an edge, and above every series' axis.
ASKED = (0.0, 420.0, 1000.0, 2510.5, 10_000_000.0)


@query("probability_at", f"""
    select site_id, series_id, facet, hour, threshold, {r('exceedance')} as exceedance, {r('density')} as density
    from dense_month join (values {", ".join(f"({t}::double)" for t in ASKED)}) v(threshold)
      on bucket = least(ceil(threshold / 50), n_buckets - 1)""")
def probability_at(fx):
    found = [grid.probability_at(steps(fx), ASKED, STEP, m) for m in ("exceedance", "density")]
    return found[0].join(found[1], [*KEYS, "facet", "hour", "threshold"])


@query("axis_from_cube", "select * from axis")
def axis_from_cube(fx):
    return grid.axis_from_cube(cube(fx), STEP)


@query("density_runs", """
    select site_id, series_id, facet, hour, level, min(bucket) as first_bucket, max(bucket) as last_bucket
    from (select *, sum(starts) over (partition by site_id, series_id, facet, hour order by bucket) as run
          from (select *, case when lag(level) over w = level and lag(bucket) over w = bucket - 1 then 0 else 1 end as starts
                from (select *, cast(least(floor(power(density, 0.6) * 10), 9) as int) as level
                      from dense_month where density > 0 and density >= 0.005) a
                window w as (partition by site_id, series_id, facet, hour order by bucket)) b) c
    group by site_id, series_id, facet, hour, run, level""")
def density_runs(fx):
    return grid.level_runs(steps(fx), "density")


@query("exceedance", f"""
    select site_id, series_id, facet, hour, bucket, bucket * 50.0::double as edge, {r('exceedance')} as exceedance from dense_month""")
def exceedance(fx):
    return probabilities(fx).drop("density", "n_buckets")


@query("density", f"""
    select site_id, series_id, facet, hour, bucket, {r('density')} as density from dense_month""")
def density(fx):
    return probabilities(fx).select(*KEYS, "facet", "hour", "bucket", "density")


@query("column_status", "select site_id, series_id, facet, hour, status from facts_month")
def column_status(fx):
    seen = grid.columns_seen(grid.with_grouping(cube(fx), "month"))
    return grid.all_hours(seen, ("facet",)).select(*KEYS, "facet", "hour", "status")


@query("facet_columns", """
    select f.*, coalesce(p.possible_days, 0) as possible_days from facts_month f left join possible p using (site_id, series_id, facet)""")
def facet_columns(fx):
    possible = coverage.possible_days(coverage.spans(fx.fx_spans, TZ), "month")
    return grid.facet_columns(cube(fx), possible)


@query("pooled_columns", f"""
    select f.*, {r('d.exceedance')} as p_half from facts_all f left join dense_all d
      on d.site_id = f.site_id and d.series_id = f.series_id and d.hour = f.hour and d.bucket = 25""")
def pooled_columns(fx):
    p = probabilities(fx, None).filter("bucket = 25").select(*KEYS, "hour", F.col("exceedance").alias("p_half"))
    return grid.pooled_columns(cube(fx)).join(p, [*KEYS, "hour"], "left")


@query("season_columns", "select * rename (facet as half_year) from facts_half")
def season_columns(fx):
    return grid.season_columns(cube(fx))


part("windows", """
    select site_id, series_id, facet, least(ceil(420 / 50.0), n_buckets - 1) * 50.0::double as threshold,
           min(hour) filter (good) as earliest, max(hour) filter (good) as latest, count(*) filter (good) as hours
    from (select site_id, series_id, month as facet, hour, n_buckets,
                 count(distinct day) >= 3 and
                 sum(case when bucket >= least(ceil(420 / 50.0), n_buckets - 1) then seconds else 0 end)::double / sum(seconds) >= 0.85::double - 1e-9::double as good
          from placed group by all) q group by all""")


def windows(fx):
    c = cube(fx)
    return grid.reliable_window(grid.with_grouping(c, "month"), grid.axis_max(fx.fx_spans, STEP), STEP, 420.0, 0.85)


@query("reliable_window", "select *, coalesce(hours = latest - earliest + 1, true) as contiguous from windows")
def reliable_window(fx):
    return windows(fx)


@query("facets_never_reaching", """
    select site_id, series_id, month as facet from placed where n_buckets > 0 group by all
    except select site_id, series_id, month from (
      select site_id, series_id, month, hour, count(distinct day) >= 3 and
             sum(case when bucket >= 90 then seconds else 0 end)::double / sum(seconds) >= 0.12::double as good from placed group by all) q where good""")
def facets_never_reaching(fx):
    c = cube(fx)
    found = grid.reliable_window(grid.with_grouping(c, "month"), grid.axis_max(fx.fx_spans, STEP), STEP, 4490.0, 0.12)
    return grid.facets_never_reaching(found).select(*KEYS, "facet")


HOURS = [f"h{h:02d}" for h in range(24)]
part("marks", """
    select site_id, series_id, cast(threshold as double) as threshold, cast(floor(threshold / 50) as int) as bucket from (
      select site_id, series_id, n_buckets, 50.0::double as threshold from axis
      union all select site_id, series_id, n_buckets, i * 1000.0::double from axis, range(20) t(i)
      where i * 1000.0 <= (n_buckets - 1) * 50 and i * 1000.0 - 50 > ((n_buckets - 1) * 50 - 50) * 0.08) q""")


@query("probability_table", "select site_id, series_id, facet, threshold, " + ", ".join(
    r(f"max(case when hour = {i} then cell end)") + f" as {h}" for i, h in enumerate(HOURS)) + """
    from (select d.site_id, d.series_id, d.facet, m.threshold, d.hour, case when f.status = 'sufficient' then d.exceedance end as cell
          from dense_month d join marks m using (site_id, series_id, bucket) join facts_month f using (site_id, series_id, facet, hour)
          union all select site_id, series_id, facet, null, hour, days from facts_month) q group by all""")
def probability_table(fx):
    c = cube(fx)
    axis = grid.axis_max(fx.fx_spans, STEP)
    seen = grid.all_hours(grid.columns_seen(grid.with_grouping(c, "month")), ("facet",))
    return grid.probability_table(steps(fx), seen, axis, STEP)


@query("level_runs", """
    select site_id, series_id, facet, hour, level, min(bucket) as first_bucket, max(bucket) as last_bucket
    from (select *, sum(starts) over (partition by site_id, series_id, facet, hour order by bucket) as run
          from (select *, case when lag(level) over w = level and lag(bucket) over w = bucket - 1 then 0 else 1 end as starts
                from (select *, cast(least(floor(power(exceedance, 0.6) * 10), 9) as int) as level
                      from dense_month where bucket >= 1 and exceedance > 0 and exceedance >= 0.005) a
                window w as (partition by site_id, series_id, facet, hour order by bucket)) b) c
    group by site_id, series_id, facet, hour, run, level""")
def level_runs(fx):
    return grid.level_runs(steps(fx))


# ---- coverage --------------------------------------------------------------------------------
part("holes", """
    select site_id, series_id, until as start_ts, start_ts as end_ts, start_ts - until as seconds
    from (select site_id, series_id, start_ts, max(end_ts) over (partition by site_id, series_id order by start_ts, end_ts
            rows between unbounded preceding and 1 preceding) as until from fx_spans) q
    where start_ts - until >= 30000""")
part("missing", """
    select site_id, series_id, facet from (select site_id, series_id, unnest(range(1, 54)) as facet from span where last_day - first_day >= 365) q
    except select site_id, series_id, cast(week(day) as int) from placed""")


@query("outages", "select * from holes")
def outages(fx):
    return coverage.outages(fx.fx_spans, 30_000)


@query("calendar_spine", """
    select site_id, series_id, cast(cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as varchar) as day from span""")
def calendar_spine(fx):
    return coverage.calendar_spine(coverage.spans(fx.fx_spans, TZ))


@query("possible_days", "select * from possible")
def possible_days(fx):
    return coverage.possible_days(coverage.spans(fx.fx_spans, TZ))


part("short_span", f"""
    select site_id, series_id, min(cast({local('start_ts')} as date)) as first_day,
           max(cast({local('end_ts - 1')} as date)) as last_day from held group by all""")


@query("missing_facets", f"""
    select site_id, series_id, w as facet, 'W' || lpad(cast(w as varchar), 2, '0') as label from (
      select site_id, series_id, cast(week(unnest(generate_series(first_day, last_day, interval 1 day))) as int) as w from short_span
      except select site_id, series_id, cast(week({local('start_ts')}) as int) from held where value > 9000
      except select site_id, series_id, cast(week({local('end_ts - 1')}) as int) from held where value > 9000) q""")
def missing_facets(fx):
    samples = intervals.state_samples(fx.fx_readings, 900)
    high = grid.exposure_cube(samples.filter("value > 9000"), TZ, STEP)
    return coverage.missing_facets(coverage.spans(samples, TZ), grid.with_grouping(high, "week"), "week")


def summary(fx):
    c = cube(fx)
    span = coverage.spans(fx.fx_spans, TZ)
    missing = coverage.missing_facets(span, grid.with_grouping(c, "week"), "week")
    return coverage.coverage_summary(
        span, grid.full_days(c, 6), coverage.outages(fx.fx_spans, 30_000), missing
    )


part("summary", """
    select s.site_id, s.series_id, s.first_ts, s.last_ts, s.first_day, s.last_day, s.last_day - s.first_day + 1 as span_days,
           d.observed_days, d.full_days, s.observed_seconds, coalesce(h.outages, 0) as outages,
           coalesce(h.missing_seconds, 0) as missing_seconds, h.longest_outage
    from span s
    join (select site_id, series_id, count(*) as observed_days, count(*) filter (hours >= 6) as full_days
          from (select site_id, series_id, day, count(distinct hour) as hours from placed group by all) q group by all) d using (site_id, series_id)
    left join (select site_id, series_id, count(*) as outages, cast(sum(seconds) as bigint) as missing_seconds,
                      max(seconds) as longest_outage from holes group by all) h using (site_id, series_id)""")


@query("coverage_summary", """
    select * replace (cast(first_day as varchar) as first_day, cast(last_day as varchar) as last_day),
           coalesce((select string_agg('W' || lpad(cast(facet as varchar), 2, '0'), ',' order by facet) from missing m
                     where m.site_id = summary.site_id and m.series_id = summary.series_id), '') as missing_facets
    from summary""")
def coverage_summary(fx):
    return summary(fx)


@query("coverage_flags", f"""
    select site_id, series_id, {r('observed_days / span_days::double')} as day_fraction,
           {r('least(missing_seconds / (span_days * 86400.0::double), 1)')} as missing_fraction,
           span_days >= 365 as full_year, observed_days < 30 or missing_seconds / (span_days * 86400.0::double) > 0.15 as sparse,
           span_days < 365 or observed_days < 30 or missing_seconds / (span_days * 86400.0::double) > 0.15 as caution
    from summary""")
def coverage_flags(fx):
    wanted = ("day_fraction", "missing_fraction", "full_year", "sparse", "caution")
    return coverage.coverage_flags(summary(fx)).select(*KEYS, *wanted)


# ---- report ----------------------------------------------------------------------------------
part("held_slices", f"""
    select *, cast({local('piece_start')} as date) as day, cast(extract(hour from {local('piece_start')}) as int) as hour
    from (select site_id, series_id, value, greatest(start_ts, h) as piece_start, least(end_ts, h + 3600) as piece_end
          from (select *, unnest(generate_series(start_ts - start_ts % 3600, end_ts - 1, 3600)) as h from held) q) p""")
part("held_axis", """
    select site_id, series_id, cast(greatest(ceil(min(value) filter (running >= 0.999::double * total) / 50), 1) as int) as top
    from (select *, sum(w) over (partition by site_id, series_id order by value) as running,
                 sum(w) over (partition by site_id, series_id) as total
          from (select site_id, series_id, value, end_ts - start_ts as w from held where value > 0) a) b
    group by site_id, series_id""")
REPORT = GridOptions(grouping="week", threshold=150.0, probability=0.9)


@query("exceedance_report", """
    select site_id, series_id, facet, 150.0::double as threshold,
           min(hour) filter (good) as earliest, max(hour) filter (good) as latest, count(*) filter (good) as hours,
           coalesce(count(*) filter (good) = max(hour) filter (good) - min(hour) filter (good) + 1, true) as contiguous
    from (select site_id, series_id, cast(week(day) as int) as facet, hour,
                 count(distinct day) >= 3 and sum(case when least(floor(value / 50), top) >= 3 then piece_end - piece_start else 0 end)::double
                   / sum(piece_end - piece_start) >= 0.9::double - 1e-9::double as good
          from held_slices join held_axis using (site_id, series_id) group by all) q group by all""")
def report(fx):
    return exceedance_report(intervals.state_samples(fx.fx_readings, 900), TZ, REPORT)["windows"]
