"""Queries over day means, degree days, meter energy, heat loss and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import TZ
from checks.q_grid import local, utc
from checks.registry import part, query, r
from holdspan.operators import benchmark, coverage, degree, heatloss, meter
from holdspan.plans.heating import analysis_readiness, degree_day_report
from holdspan.sources import rooms as dimension

SITE = ("site_id",)
SENSOR = ("site_id", "sensor")


def day_part(source: str, keys: str) -> str:
    return f"""
    select *, {utc('day + 1')} - {utc('day')} as day_seconds
    from (select {keys}, day, sum(value * seconds) / sum(seconds) as mean, cast(sum(seconds) as bigint) as covered_seconds
          from (select {keys}, value, cast({local('greatest(start_ts, h)')} as date) as day, least(end_ts, h + 3600) - greatest(start_ts, h) as seconds
                from (select *, unnest(generate_series(start_ts // 3600 * 3600, end_ts - 1, 3600)) as h from {source}) a) b
          group by {keys}, day) c"""


part("outside_days", day_part("fx_outside", "site_id"))
part("sensor_days", day_part("fx_rooms", "site_id, sensor"))
part("outside_counted", """
    select *, greatest(15 - mean, 0) as hdd, greatest(mean - 21, 0) as cdd from outside_days where covered_seconds / day_seconds::double >= 0.9""")
part("outside_bounds", "select site_id, min(day) as first_day, max(day) as last_day from outside_days group by site_id")


def outside_days(fx):
    return degree.daily_means(fx.fx_outside, TZ, SITE)


def sensor_days(fx):
    return degree.daily_means(fx.fx_rooms, TZ, SENSOR)


@query("daily_means", f"""
    select site_id, sensor, cast(day as varchar) as day, {r('mean')} as mean, covered_seconds, day_seconds from sensor_days""")
def daily_means(fx):
    return sensor_days(fx)


@query("counted_days", """
    select site_id, sensor, count(*) filter (covered_seconds / day_seconds::double >= 0.9) as counted_days,
           count(*) filter (covered_seconds / day_seconds::double < 0.9) as short_days,
           cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day from sensor_days group by all""")
def counted_days(fx):
    return degree.counted_days(sensor_days(fx), keys=SENSOR)


def room_part(dim: str) -> str:
    return f"""
    select site_id, floor_pos, room_pos, day, avg(mean) as mean, max(covered_seconds) as covered_seconds, max(day_seconds) as day_seconds,
           max(sensors) > 1 and count(*) < max(sensors) as partial
    from sensor_days join (select *, count(*) over (partition by site_id, floor_pos, room_pos) as sensors from {dim}) d using (site_id, sensor)
    where sensors = 1 or covered_seconds / day_seconds::double >= 0.9 group by site_id, floor_pos, room_pos, day"""


part("room_days", room_part("dim_rooms"))
part("shared_days", room_part("dim_shared"))


@query("group_days", f"select * replace (cast(day as varchar) as day, {r('mean')} as mean) from shared_days")
def group_days(fx):
    return degree.group_days(sensor_days(fx), fx.shared_rooms)


@query("degree_days", f"""
    select cast(day as varchar) as day, {r('mean')} as mean, {r('hdd')} as hdd, {r('cdd')} as cdd from outside_counted""")
def degree_days(fx):
    counted = outside_days(fx).filter(degree.is_counted(0.9))
    return degree.degree_days(counted).select("day", "mean", "hdd", "cdd")


def grains(rows: str, columns: str) -> str:
    return " union all ".join(
        f"select {columns}, '{g}' as grain, {y} as year, {p} as part from {rows}"
        for g, y, p in (
            ("month", "cast(year(day) as int)", "cast(month(day) as int)"),
            ("year", "cast(year(day) as int)", "null::int"),
            ("record", "null::int", "null::int"),
        )
    )


part("spine", "select site_id, cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as day from outside_bounds")
part("spine_grains", grains("spine", "site_id"))
part("outside_grains", grains("outside_counted", "site_id, mean, hdd, cdd"))
part("periods", """
    select p.site_id, p.grain, p.year, p.part, coalesce(days, 0) as days, possible_days, outside, coalesce(hdd, 0) as hdd, coalesce(cdd, 0) as cdd
    from (select site_id, grain, year, part, count(*) as possible_days from spine_grains group by all) p
    left join (select site_id, grain, year, part, count(*) as days, avg(mean) as outside, sum(hdd) as hdd, sum(cdd) as cdd
               from outside_grains group by all) c
      on c.site_id = p.site_id and c.grain = p.grain and c.year is not distinct from p.year and c.part is not distinct from p.part
    where days > 0 or p.grain = 'record'""")


def periods(fx):
    return degree.period_summary(outside_days(fx), keys=SITE)


@query("period_summary", f"select * replace ({r('outside')} as outside, {r('hdd')} as hdd, {r('cdd')} as cdd) from periods")
def period_summary(fx):
    return periods(fx)


part("both_days", """
    select r.site_id, r.floor_pos, r.room_pos, r.day, r.mean from room_days r
    join outside_counted o on o.site_id = r.site_id and o.day = r.day where r.covered_seconds / r.day_seconds::double >= 0.9""")
part("room_grains", grains("both_days", "site_id, floor_pos, room_pos, mean"))
part("room_periods", "select site_id, grain, year, part, floor_pos, room_pos, avg(mean) as mean, count(*) as days from room_grains group by all")
part("floor_periods", "select site_id, grain, year, part, floor_pos, avg(mean) as mean from room_periods group by all")


def rooms_by_period(fx):
    return degree.room_means(degree.group_days(sensor_days(fx), fx.rooms), outside_days(fx))


@query("room_means", f"select * replace ({r('mean')} as mean) from room_periods")
def room_means(fx):
    return rooms_by_period(fx)


@query("floor_means", f"select * replace ({r('mean')} as mean) from floor_periods")
def floor_means(fx):
    return degree.floor_means(rooms_by_period(fx))


@query("coldest_period", f"""
    select site_id, grain, year, part, days, {r('hdd')} as hdd from periods where grain = 'month' and hdd > 0 order by hdd desc limit 1""")
def coldest_period(fx):
    return degree.coldest_period(periods(fx), keys=SITE).select("site_id", "grain", "year", "part", "days", "hdd")


@query("period_report", f"""
    select p.site_id, p.grain, p.year, p.part,
           case p.grain when 'month' then strftime(make_date(p.year, p.part, 1), '%B %Y') when 'year' then cast(p.year as varchar) else 'Whole record' end as label,
           case when days >= possible_days then days || ' days' else days || ' of ' || possible_days || ' days' end as days,
           {r('outside')} as outside, {r('hdd')} as hdd, {r('cdd')} as cdd, {r('f0.mean')} as floor_0, {r('f1.mean')} as floor_1
    from periods p
    left join floor_periods f0 on f0.floor_pos = 0 and f0.grain = p.grain and f0.year is not distinct from p.year and f0.part is not distinct from p.part
    left join floor_periods f1 on f1.floor_pos = 1 and f1.grain = p.grain and f1.year is not distinct from p.year and f1.part is not distinct from p.part""")
def period_report(fx):
    return degree.period_report(periods(fx), degree.floor_means(rooms_by_period(fx)), 2)


@query("thermometer_days", """
    select site_id, sensor, count(*) as observed_days, count(*) filter (covered_seconds >= 72000) as full_days,
           string_agg(distinct cast(month(day) as varchar), ',' order by cast(month(day) as varchar)) as months
    from sensor_days group by site_id, sensor""")
def thermometer_days(fx):
    days = coverage.thermometer_days(sensor_days(fx), SENSOR)
    return days.withColumn("months", F.array_sort(F.col("months").cast("array<string>")))


# ---- meter -----------------------------------------------------------------------------------
def readings(fx):
    return meter.meter_readings(fx.fx_meter_flawed, SITE)


@query("asof_total", f"""
    select s.id, s.start_ts as ts, {r('m.total')} as total from fx_spans s asof left join fx_meter_flawed m
      on s.site_id = m.site_id and s.start_ts >= m.ts""")
def asof_total(fx):
    probes = fx.fx_spans.select("site_id", "id", F.col("start_ts").alias("ts"))
    return meter.asof_total(probes, readings(fx), SITE).select("id", "ts", "total")


part("month_list", f"""
    select site_id, cast(m as date) as m, first_total, data_end, first_day, last_day from (
      select *, unnest(generate_series(date_trunc('month', cast({local('first_ts')} as date)), cast({local('data_end')} as date), interval 1 month)) as m
      from (select x.site_id, x.first_ts, x.first_total, first_day, last_day, greatest(last_ts, {utc('last_day + 1')}) as data_end
            from (select site_id, min(ts) as first_ts, max(ts) as last_ts, min_by(total, ts) as first_total from fx_meter_flawed group by site_id) x
            join outside_bounds using (site_id)) y) z""")
part("month_probes", f"""
    select l.site_id, m, first_total, data_end, first_day, last_day, {utc('m - 1')} as p,
           max_by(total, ts) filter (ts <= {utc('m')}) as at_start, max(ts) filter (ts <= {utc('m')}) as read_ts,
           max_by(total, ts) filter (ts <= {utc('m + 1')}) as after
    from month_list l join fx_meter_flawed r on r.site_id = l.site_id group by all""")
part("openings", """
    select *, case when at_start is null and after is not null then first_total
                   when at_start is not null and after is not null and (read_ts <= p or after < at_start) then after else at_start end as opening
    from month_probes""")
part("closed", f"""
    select site_id, m as month, closing - opening as kwh, not (m between date_trunc('month', first_day) and date_trunc('month', last_day)) as beyond
    from (select *, lead(opening) over (partition by site_id order by m) as closing from openings) q
    where {utc('cast(m + interval 1 month as date) + 1')} <= data_end and opening is not null and closing is not null""")
part("weather", """
    select site_id, cast(date_trunc('month', day) as date) as month, count(*) as counted_days, sum(hdd) as hdd, avg(mean) as outside_mean
    from outside_counted group by all""")
part("judged", """
    select *, left_out is null as fitted, left_out is null or left_out = 'few_days' as sound,
           cast(case when month(month) >= 7 then year(month) else year(month) - 1 end as int) as season,
           case when counted_days > 0 then hdd * d / counted_days else 0 end as whole_hdd
    from (select site_id, month, kwh, coalesce(counted_days, 0) as counted_days, coalesce(hdd, 0) as hdd, outside_mean, day(last_day(month)) as d,
                 case when kwh < 0 then 'went_down' when kwh = 0 then 'unchanged'
                      when lag(kwh) over w = 0 and lag(month) over w = month - interval 1 month then 'after_unchanged'
                      when coalesce(counted_days, 0) < 0.9 * day(last_day(month)) then 'few_days' end as left_out
          from closed left join weather using (site_id, month) where not beyond
          window w as (partition by site_id order by month)) q""")
part("own_load", """
    select site_id, season, sum(kwh) / sum(d) as per_day, sum(kwh) / 3 as per_month
    from (select *, row_number() over (partition by site_id, season order by outside_mean desc, month) as k
          from judged where fitted and month(month) between 5 and 9 and outside_mean is not null) q
    where k <= 3 group by all having count(*) = 3""")
part("near_load", """
    select site_id, season, from_season, per_day, per_month from (
      select s.site_id, s.season, o.season as from_season, o.per_day, o.per_month,
             row_number() over (partition by s.site_id, s.season order by abs(o.season - s.season), o.season) as k
      from (select distinct site_id, season from judged) s left join own_load o using (site_id)) q where k = 1""")
part("heating", """
    select j.*, coalesce(per_day * d, 0) as base_kwh, kwh - coalesce(per_day * d, 0) as heating_kwh
    from judged j left join near_load using (site_id, season)""")


def line_sql(x: str, y: str, where: str, spread: float) -> str:
    ok = f"count(*) filter ({where}) >= 3 and max({x}) filter ({where}) - min({x}) filter ({where}) >= {spread}"
    slope = f"regr_slope({y}, {x}) filter ({where})"
    ssr = (f"greatest(regr_syy({y}, {x}) filter ({where}) - power(regr_sxy({y}, {x}) filter ({where}), 2)"
           f" / regr_sxx({y}, {x}) filter ({where}), 0)")
    return f"""
           case when {ok} then {slope} end as slope,
           case when {ok} then regr_intercept({y}, {x}) filter ({where}) end as base,
           case when {ok} then regr_r2({y}, {x}) filter ({where}) end as r2,
           case when {ok} then sqrt({ssr} / (count(*) filter ({where}) - 2) / regr_sxx({y}, {x}) filter ({where})) end as slope_error,
           case when {ok} then count(*) filter ({where}) end as points"""


part("season_lines", f"""
    select site_id, season, count(*) as months, count(*) filter (fitted) as fitted,
           coalesce(sum(heating_kwh) filter (sound), 0) as sound_kwh, {line_sql('whole_hdd', 'heating_kwh', 'fitted', 15)}
    from (select * from heating union all select * replace (null::int as season) from heating) q group by site_id, season""")


@query("month_start_total", f"select site_id, cast(m as varchar) as month, {r('opening')} as total from openings")
def month_start_total(fx):
    return meter.month_start_total(readings(fx), outside_days(fx), TZ).select("site_id", "month", "total")


@query("month_energy", f"select site_id, cast(month as varchar) as month, {r('kwh')} as kwh, beyond from closed")
def month_energy(fx):
    return meter.month_energy(readings(fx), outside_days(fx), TZ).select("site_id", "month", "kwh", "beyond")


@query("month_weather", f"""
    select site_id, cast(month as varchar) as month, counted_days, {r('hdd')} as hdd, {r('outside_mean')} as outside_mean from weather""")
def month_weather(fx):
    return meter.month_weather(outside_days(fx))


def months(fx):
    return meter.left_out(meter.month_energy(readings(fx), outside_days(fx), TZ))


@query("left_out", f"select site_id, cast(month as varchar) as month, {r('kwh')} as kwh, left_out, fitted, sound, season from judged")
def left_out(fx):
    return months(fx).select("site_id", "month", "kwh", "left_out", "fitted", "sound", "season")


@query("whole_month_hdd", f"select site_id, cast(month as varchar) as month, {r('hdd')} as hdd, {r('whole_hdd')} as whole_hdd from judged")
def whole_month_hdd(fx):
    return months(fx).select("site_id", "month", "hdd", "whole_hdd")


@query("base_load", f"select site_id, season, {r('per_day')} as per_day, {r('per_month')} as per_month from own_load")
def base_load(fx):
    return meter.base_load(months(fx))


@query("nearest_base_load", f"select site_id, season, from_season, {r('per_day')} as per_day, {r('per_month')} as per_month from near_load")
def nearest_base_load(fx):
    return meter.nearest_base_load(months(fx))


def heating(fx):
    return meter.heating_energy(months(fx))


def seasons(fx):
    return meter.efficiency(heating(fx))


ROUNDED_LINE = ", ".join(f"{r(c)} as {c}" for c in ("slope", "base", "r2", "slope_error"))


@query("efficiency", f"select * replace ({r('sound_kwh')} as sound_kwh, {ROUNDED_LINE}) from season_lines")
def efficiency(fx):
    return seasons(fx).drop("per_month", "from_season")


@query("fit_line", f"""
    select o_custkey % 50 as grp, {', '.join(r(c) + ' as ' + c for c in ('slope', 'base', 'r2', 'slope_error'))}, points
    from (select o_custkey % 50 as o_custkey, {line_sql('x', 'y', 'true', 15)}
          from (select o_custkey, o_orderkey % 1000 as x, o_totalprice / 1000 as y from orders) a group by o_custkey % 50) q""")
def fit_line(fx):
    from holdspan.operators.regress import fit_line as line

    points = fx.table("orders").select(
        (F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 1000).cast("double").alias("x"),
        (F.col("o_totalprice") / 1000).alias("y"),
    )
    return points.groupBy("grp").agg(line(F.col("x"), F.col("y"), 15.0).alias("l")).select("grp", "l.*")


part("changes", """
    select site_id, season, slope, case when slope is not null then before end as before, slope / before_slope - 1 as change
    from (select *, last_value(case when slope is not null then season end ignore nulls) over w as before,
                 last_value(slope ignore nulls) over w as before_slope
          from season_lines where season is not null
          window w as (partition by site_id order by season rows between unbounded preceding and 1 preceding)) q""")


@query("season_change", f"select site_id, season, {r('slope')} as slope, before, {r('change')} as change from changes")
def season_change(fx):
    return meter.season_change(seasons(fx)).select("site_id", "season", "slope", "before", "change")


@query("month_report", f"""
    select site_id, cast(month as varchar) as month, strftime(month, '%B %Y') as label, {r('kwh')} as kwh, {r('base_kwh')} as base_kwh,
           {r('heating_kwh')} as heating_kwh, counted_days, {r('outside_mean')} as outside_mean,
           {r('case when counted_days > 0 then whole_hdd end')} as whole_hdd,
           {r('case when counted_days > 0 and whole_hdd <> 0 then heating_kwh / whole_hdd end')} as per_degree_day, left_out from heating""")
def month_report(fx):
    return meter.month_report(heating(fx))


@query("season_report", f"""
    select l.site_id, l.season, l.season || '/' || lpad(cast((l.season + 1) % 100 as varchar), 2, '0') as label, months, fitted,
           {r('sound_kwh')} as sound_kwh, {r('l.slope')} as slope, {r('slope_error')} as slope_error, {r('r2')} as r2,
           {r('per_month')} as per_month, from_season, before, {r('change')} as change
    from season_lines l left join near_load n on n.site_id = l.site_id and n.season = l.season
    left join changes c on c.site_id = l.site_id and c.season = l.season where l.season is not null""")
def season_report(fx):
    return meter.season_report(seasons(fx))


# ---- heat loss -------------------------------------------------------------------------------
def hour_part(source: str, keys: str) -> str:
    return f"""
    select {keys}, h as hour_ts, sum(value * seconds) / sum(seconds) as mean
    from (select *, least(end_ts, h + 3600) - greatest(start_ts, h) as seconds
          from (select *, unnest(generate_series(start_ts // 3600 * 3600, end_ts - 1, 3600)) as h from {source}) a) b
    group by {keys}, h having sum(seconds) >= 0.9 * 3600"""


part("outside_hours", hour_part("fx_outside", "site_id"))
part("sensor_hours", hour_part("fx_rooms", "site_id, sensor"))
part("room_hours", "select site_id, floor_pos, room_pos, hour_ts, avg(mean) as mean from sensor_hours join dim_shared using (site_id, sensor) group by all")
part("house", """
    select site_id, hour_ts, sum(area * mean) / 44 as house from room_hours
    join (select distinct site_id, floor_pos, room_pos, area from dim_shared where area is not null) a using (site_id, floor_pos, room_pos)
    group by all having count(*) = 2""")
part("degree_hours", f"""
    select *, degree_hours * hours / counted_hours as whole_degree_hours, counted_hours / greatest(hours, 1)::double as coverage
    from (select site_id, month, cast(({utc('month + interval 1 month')} - {utc('month')}) / 3600 as int) as hours, count(*) as counted_hours,
                 sum(house - mean) as degree_hours, sum(house) as house_sum
          from (select h.site_id, house, mean, cast(date_trunc('month', {local('hour_ts + 1800')}) as date) as month
                from house h join outside_hours o using (site_id, hour_ts)) a group by site_id, month) b""")


def sensor_hours(fx):
    return heatloss.hourly_means(fx.fx_rooms, keys=SENSOR)


@query("hourly_means", f"select site_id, sensor, hour_ts, {r('mean')} as mean from sensor_hours")
def hourly_means(fx):
    return sensor_hours(fx)


@query("group_hours", f"select site_id, floor_pos, room_pos, hour_ts, {r('mean')} as mean from room_hours")
def group_hours(fx):
    return heatloss.group_hours(sensor_hours(fx), fx.shared_rooms)


def house(fx):
    return heatloss.house_hours(group_hours(fx), fx.shared_rooms)


@query("house_hours", f"select site_id, hour_ts, {r('house')} as house from house")
def house_hours(fx):
    return house(fx)


def hours(fx):
    return heatloss.degree_hours(house(fx), heatloss.hourly_means(fx.fx_outside, keys=SITE), TZ)


@query("degree_hours", f"""
    select site_id, cast(month as varchar) as month, counted_hours, {r('degree_hours')} as degree_hours, {r('house_sum')} as house_sum, hours,
           {r('whole_degree_hours')} as whole_degree_hours, {r('coverage')} as coverage from degree_hours""")
def degree_hours(fx):
    return hours(fx)


part("loss_months", """
    select h.*, hours, counted_hours, house_sum, whole_degree_hours,
           case when not fitted then 'energy' when coalesce(outside_mean >= 15, true) then 'mild' when coalesce(coverage < 0.7, true) then 'few_hours' end as not_counted
    from heating h left join degree_hours d using (site_id, month)""")
part("loss_months_strict", """
    select h.*, case when not fitted then 'energy' when coalesce(outside_mean >= 15, true) then 'mild' when coalesce(coverage < 0.9, true) then 'few_hours' end as not_counted
    from heating h left join degree_hours d using (site_id, month)""")


@query("heating_months", f"""
    select site_id, cast(month as varchar) as month, {r('heating_kwh')} as heating_kwh, not_counted from loss_months_strict""")
def heating_months(fx):
    return heatloss.heating_months(heating(fx), hours(fx)).select("site_id", "month", "heating_kwh", "not_counted")


# The house of one room, seen almost every day, so that months do count.
part("one_room", "select site_id, hour_ts, avg(mean) as house from sensor_hours group by site_id, hour_ts")
part("one_degree_hours", f"""
    select *, degree_hours * hours / counted_hours as whole_degree_hours, counted_hours / greatest(hours, 1)::double as coverage
    from (select site_id, month, cast(({utc('month + interval 1 month')} - {utc('month')}) / 3600 as int) as hours, count(*) as counted_hours,
                 sum(house - mean) as degree_hours, sum(house) as house_sum
          from (select h.site_id, house, mean, cast(date_trunc('month', {local('hour_ts + 1800')}) as date) as month
                from one_room h join outside_hours o using (site_id, hour_ts)) a group by site_id, month) b""")
part("one_loss_months", """
    select h.*, hours, counted_hours, house_sum, whole_degree_hours,
           case when not fitted then 'energy' when coalesce(outside_mean >= 15, true) then 'mild' when coalesce(coverage < 0.9, true) then 'few_hours' end as not_counted
    from heating h left join one_degree_hours d using (site_id, month)""")
part("loss_lines", f"""
    select site_id, season, count(*) filter (not_counted is null) as heating_months,
           cast(coalesce(sum(hours) filter (not_counted is null), 0) as bigint) as heating_hours,
           cast(coalesce(sum(counted_hours) filter (not_counted is null), 0) as bigint) as counted,
           sum(house_sum) filter (not_counted is null) as house_sum, coalesce(sum(heating_kwh) filter (sound), 0) as sound_kwh,
           {line_sql('whole_degree_hours', 'heating_kwh', 'not_counted is null', 360)}
    from (select * from one_loss_months union all select * replace (null::int as season) from one_loss_months) q group by site_id, season""")
part("losses", """
    select site_id, season, heating_months, heating_hours, sound_kwh,
           case when slope > 0 then slope end as loss_slope, case when slope > 0 then slope * 1000 end as watts_per_kelvin,
           case when slope > 0 then r2 end as r2, case when slope > 0 then slope_error end as slope_error,
           case when slope > 0 then house_sum / counted end as house,
           case when slope > 0 and -base * 1000 / (heating_hours / points::double) >= 10 then -base * 1000 / (heating_hours / points::double) end as free_heat_watts
    from loss_lines""")


def one_house(fx):
    return sensor_hours(fx).groupBy("site_id", "hour_ts").agg(F.avg("mean").alias("house"))


def losses(fx):
    hours = heatloss.degree_hours(one_house(fx), heatloss.hourly_means(fx.fx_outside, keys=SITE), TZ)
    return heatloss.heat_loss(heatloss.heating_months(heating(fx), hours))


@query("heat_loss", "select * replace (" + ", ".join(
    f"{r(c)} as {c}" for c in ("sound_kwh", "loss_slope", "watts_per_kelvin", "r2", "slope_error", "house", "free_heat_watts")) + ") from losses")
def heat_loss(fx):
    return losses(fx).drop("slope")


@query("change_cause", f"""
    select site_id, season, b as before, {r('dd - 1')} as per_degree_day, {r('ll - 1')} as heat_loss, {r('hh')} as house,
           case when abs(dd - 1) < 0.03 then 'held' when ln(ll) / ln(dd) >= 2 / 3.0::double then 'building'
                when ln(ll) / ln(dd) <= 1 / 3.0::double then 'behaviour' else 'both' end as cause
    from (select site_id, season, lag(season) over w as b, slope / lag(slope) over w as dd, loss_slope / lag(loss_slope) over w as ll,
                 house - lag(house) over w as hh
          from losses join (select site_id, season, slope from season_lines) s using (site_id, season)
          where season is not null and slope is not null and loss_slope is not null
          window w as (partition by site_id order by season)) q
    where b is not null and dd > 0""")
def change_cause(fx):
    return heatloss.change_cause(losses(fx))


@query("degree_warmer", f"""
    select l.site_id, l.season, heating_months, {r('sound_kwh')} as sound_kwh, {r('watts_per_kelvin')} as watts_per_kelvin,
           {r('loss_slope * heating_hours')} as degree_kwh,
           {r('case when sound_kwh > 0 then loss_slope * heating_hours / sound_kwh end')} as degree_share,
           {r('whole * heating_hours')} as by_overall_kwh,
           coalesce(l.season = (select season from losses where season is not null and heating_months > 0 order by heating_months desc, season desc limit 1), false) as fullest
    from losses l join (select site_id, loss_slope as whole from losses where season is null) o using (site_id)""")
def degree_warmer(fx):
    return heatloss.degree_warmer(losses(fx))


# ---- benchmark -------------------------------------------------------------------------------
part("years", """
    select *, row_number() over (partition by site_id order by last_month desc) = 1 as latest,
           case when month(first_month) = 7 then cast(year(first_month) as int) end as season
    from (select a.site_id, a.month as first_month, cast(a.month + interval 11 month as date) as last_month, sum(b.heating_kwh) as heating_kwh, sum(b.kwh) as kwh
          from heating a join heating b on b.site_id = a.site_id and b.month between a.month and a.month + interval 11 month
          group by a.site_id, a.month having count(*) = 12 and bool_and(b.sound)) q""")


@query("sound_years", f"""
    select site_id, cast(first_month as varchar) as first_month, cast(last_month as varchar) as last_month, {r('heating_kwh')} as heating_kwh,
           {r('kwh')} as kwh, season, latest from years where latest or season is not null""")
def sound_years(fx):
    return benchmark.sound_years(heating(fx))


def klass(x: str) -> str:
    bounds = (("A+", 30), ("A", 50), ("B", 75), ("C", 100), ("D", 130), ("E", 160), ("F", 200), ("G", 250))
    return f"case when {x} is null then null " + " ".join(f"when {x} < {b} then '{c}'" for c, b in bounds) + " else 'H' end"


@query("per_square_metre", f"""
    select site_id, cast(first_month as varchar) as first_month, latest, season || '/' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as label,
           {r('heating_kwh / 84.0')} as per_heated, {klass('heating_kwh / 84.0')} as heated_class,
           {r('heating_kwh / 120.0')} as per_total, {klass('heating_kwh / 120.0')} as total_class
    from years where latest or season is not null""")
def per_square_metre(fx):
    areas = dimension.house_areas(fx.rooms, fx.houses)
    out = benchmark.per_square_metre(benchmark.sound_years(heating(fx)), areas)
    return out.drop("last_month", "heating_kwh", "kwh", "season")


# ---- dimension and reports -------------------------------------------------------------------
@query("house_areas", """
    select 0 as site_id, sum(area) as rooms_area, sum(area) as heated_area, true as heated_from_rooms, 120.0::double as total_area from dim_rooms""")
def house_areas(fx):
    return dimension.house_areas(fx.rooms, fx.houses)


part("supplier_rooms", """
    select s_nationkey as site_id, cast(s_suppkey % 2 as int) as floor_pos, case s_nationkey % 7 when 3 then ' ' else 'F' || (s_suppkey % 2) % (1 + s_nationkey % 2) end as floor,
           cast(s_suppkey % 5 as int) as room_pos, 'room ' || (s_suppkey % 3) as room, 'sensor.' || (s_suppkey % 11) as sensor,
           case when s_acctbal % 3 < 2 then s_acctbal / 100 end as area
    from supplier""")
VIOLATIONS = """
    with d as (select distinct site_id, floor_pos, trim(floor) as floor, room_pos, room, sensor, area from supplier_rooms),
    rm as (select site_id, floor_pos, floor, room_pos, room, max(area) as area from d group by all),
    fl as (select distinct site_id, floor_pos, floor from d),
    ar as (select site_id, case when sum(area) > 0 then sum(area) end as heated from (select site_id, floor_pos, room_pos, max(area) as area from d group by all) a group by site_id)
    select site_id, 'empty_floor' as code, cast(floor_pos as varchar) as subject from fl where floor = ''
    union all select site_id, 'duplicate_floor', floor from fl where floor <> '' group by all having count(*) > 1
    union all select site_id, 'duplicate_room', floor || ' / ' || room from rm group by site_id, floor_pos, floor, room having count(*) > 1
    union all select site_id, 'sensor_listed_twice', sensor from (select site_id, floor_pos, room_pos, trim(floor) as floor, room, sensor from supplier_rooms) z
      group by site_id, floor_pos, room_pos, floor, room, sensor having count(*) > 1
    union all select site_id, 'sensor_in_two_rooms', sensor from (select distinct site_id, sensor, floor_pos, room_pos from d) s group by all having count(*) > 1
    union all select site_id, 'room_area', floor || ' / ' || room from rm where area <= 0
    union all select site_id, 'total_below_heated', '150.0' from ar where heated > 150"""


@query("check_rooms", f"select * from ({VIOLATIONS}) v")
def check_rooms(fx):
    rooms = fx.spark.sql(
        """select s_nationkey as site_id, cast(s_suppkey % 2 as int) as floor_pos,
                  case s_nationkey % 7 when 3 then ' ' else 'F' || (s_suppkey % 2) % (1 + s_nationkey % 2) end as floor,
                  cast(s_suppkey % 5 as int) as room_pos, 'room ' || (s_suppkey % 3) as room, 'sensor.' || (s_suppkey % 11) as sensor,
                  case when s_acctbal % 3 < 2 then s_acctbal / 100 end as area from {supplier}""",
        supplier=fx.table("supplier"),
    )
    houses = rooms.select("site_id").distinct().select(
        "site_id", F.lit(None).cast("double").alias("heated_area"), F.lit(150.0).alias("total_area")
    )
    return dimension.check_rooms(rooms, houses)


NEEDS = (
    ("degree_day_cost", ("energy",)),
    ("building_or_behaviour", ("energy", "rooms", "room_areas")),
    ("degree_warmer", ("energy", "rooms", "room_areas")),
    ("benchmark", ("energy", "rooms", "heated_area")),
    ("indoor_temperatures", ("rooms",)),
)
part("given", """
    select n_nationkey as site_id, n_nationkey % 2 = 0 as energy, r.site_id is not null as rooms, coalesce(r.area > 0, false) as room_areas,
           coalesce(r.area > 0, false) as heated_area
    from nation left join (select s_nationkey as site_id, sum(case when s_nationkey % 3 = 1 then s_acctbal end) as area
                           from supplier where s_nationkey % 3 > 0 group by s_nationkey) r on r.site_id = n_nationkey""")


@query("analysis_readiness", " union all ".join(
    f"select site_id, '{s}' as section, '{n}' as need from given where not {n}" for s, ns in NEEDS for n in ns))
def readiness(fx):
    sites = fx.table("nation").select(F.col("n_nationkey").alias("site_id"))
    rooms = fx.table("supplier").filter("s_nationkey % 3 > 0").select(
        F.col("s_nationkey").alias("site_id"), F.lit(0).alias("floor_pos"), F.col("s_suppkey").alias("room_pos"),
        F.when(F.col("s_nationkey") % 3 == 1, F.col("s_acctbal")).alias("area"),
    )
    houses = sites.select("site_id", F.lit(None).cast("double").alias("heated_area"), F.lit(None).cast("double").alias("total_area"))
    return analysis_readiness(sites, sites.filter("site_id % 2 = 0"), rooms, houses)


part("five_hours", """
    select site_id, hour_ts, sum(area * mean) / 84 as house from sensor_hours join dim_rooms using (site_id, sensor) group by all having count(*) = 5""")
part("five_months", f"""
    select site_id, month, n / (({utc('month + interval 1 month')} - {utc('month')}) / 3600)::double as coverage
    from (select h.site_id, cast(date_trunc('month', {local('hour_ts + 1800')}) as date) as month, count(*) as n
          from five_hours h join outside_hours o using (site_id, hour_ts) group by all) a""")
part("loss_all", """
    select h.*, case when not fitted then 'energy' when coalesce(outside_mean >= 15, true) then 'mild' when coalesce(coverage < 0.9, true) then 'few_hours' end as not_counted
    from heating h left join five_months using (site_id, month)""")


@query("degree_day_report", f"""
    select h.site_id, cast(h.month as varchar) as month, {r('h.heating_kwh')} as heating_kwh, left_out, not_counted,
           {r('p.hdd')} as hdd, p.days as days, {r('f.mean')} as ground
    from loss_all h join periods p on p.grain = 'month' and p.year = year(month) and p.part = month(month)
    left join floor_periods f on f.floor_pos = 0 and f.grain = 'month' and f.year = year(month) and f.part = month(month)""")
def report(fx):
    t = degree_day_report(fx.fx_outside, fx.fx_rooms, fx.fx_meter_flawed, fx.rooms, fx.houses, TZ)
    month = (F.year("month") == F.col("year")) & (F.month("month") == F.col("part"))
    p = t["periods"].filter("grain = 'month'").select("site_id", "year", "part", "hdd", "days")
    f = t["floors"].filter("grain = 'month' and floor_pos = 0").select(
        "site_id", "year", "part", F.col("mean").alias("ground"))
    weather = p.join(f, ["site_id", "year", "part"], "left")
    rows = t["loss_months"].select("site_id", "month", "heating_kwh", "left_out", "not_counted")
    return rows.join(weather, (rows.site_id == weather.site_id) & month).select(
        rows.site_id, "month", "heating_kwh", "left_out", "not_counted", "hdd", "days", "ground")
