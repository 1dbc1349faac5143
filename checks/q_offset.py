"""Queries over settings that correct a sensor."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import part, query, r
from holdspan.operators import intervals, offset

SENSOR = ("site_id", "sensor")
MEASURE = "temperature|temperatur|local|lokale|lokaler|current"
WORDS = "offset|calibration|kalibrierung|versatz|korrektur"

part("devices", f"""
    select site_id, sensor, regexp_replace(split_part(sensor, '.', 2), '((^|_)({MEASURE}))+$', '') as device from fx_entities""")
part("matches", f"""
    select d.site_id, d.sensor, e.setting from devices d join fx_entities e on e.site_id = d.site_id
    where device <> '' and starts_with(split_part(e.setting, '.', 2), device || '_')
      and regexp_full_match(substr(split_part(e.setting, '.', 2), length(device) + 2),
                            '({MEASURE}|[^_]*({WORDS})[^_]*)(_({MEASURE}|[^_]*({WORDS})[^_]*))*')
      and regexp_matches(substr(split_part(e.setting, '.', 2), length(device) + 2), '{WORDS}')""")


@query("match_settings", "select * from matches")
def match_settings(fx):
    names = fx.fx_entities
    return offset.match_settings(names.select(*SENSOR), names.select("site_id", "setting"))


part("setting_steps", """
    select site_id, setting, ts, row_id, value, lag(value) over w as before, lead(ts) over w as next_ts
    from (select *, lag(value) over (partition by site_id, setting order by ts, row_id) as b,
                 row_number() over (partition by site_id, setting order by ts, row_id) as n from fx_settings) q
    where n = 1 or b <> value window w as (partition by site_id, setting order by ts, row_id)""")
part("setting_spans", f"""
    select site_id, setting, case when before is null then {offset.ALWAYS} else ts end as from_ts,
           coalesce(next_ts, {offset.FOREVER}) as to_ts, ts as changed_ts, before, value as degrees from setting_steps""")


def spans(fx):
    return offset.setting_intervals(fx.fx_settings)


@query("setting_intervals", "select * from setting_spans")
def setting_intervals(fx):
    return spans(fx)


part("thermometer_samples", """
    select site_id, sensor, ts as start_ts, least(coalesce(nxt, ts + 900), ts + 900) as end_ts, value
    from (select *, lead(ts) over (partition by site_id, sensor order by ts, row_id) as nxt from fx_thermometer) q
    where least(coalesce(nxt, ts + 900), ts + 900) > ts""")


def samples(fx):
    return intervals.state_samples(fx.fx_thermometer, 900, keys=SENSOR)


def of_sensor(fx):
    sensor = F.regexp_replace(F.regexp_replace("setting", "^number", "sensor"), "_offset$", "")
    return spans(fx).withColumn("sensor", sensor).drop("setting")


@query("apply_offset", f"""
    select s.site_id, s.sensor, greatest(start_ts, from_ts) as start_ts, least(end_ts, to_ts) as end_ts, {r('value + 0.5 * degrees')} as value
    from thermometer_samples s join setting_spans p on p.site_id = s.site_id and least(end_ts, to_ts) > greatest(start_ts, from_ts)
    union all
    select site_id, sensor, start_ts, end_ts, {r('value')} as value
    from thermometer_samples where site_id not in (select site_id from setting_spans)""")
def apply_offset(fx):
    return offset.apply_offset(samples(fx), of_sensor(fx), sign=-1, scale=0.5)


part("moves", """
    select c.site_id, c.setting, c.ts as changed_ts, c.value - c.before as step,
           (select {'ts': ts, 'value': value} from fx_thermometer t where t.site_id = c.site_id and t.ts < c.ts - 60 order by ts desc, row_id desc limit 1) as prior
    from setting_steps c where abs(c.value - c.before) >= 0.5""")
part("judged_moves", """
    select site_id, 'sensor.s' || site_id || '_temperature' as sensor, changed_ts, step, moved,
           case when abs(moved) < abs(step) / 2 then 'unmoved' when sign(moved) = sign(step) then 'added' else 'subtracted' end as verdict
    from (select m.site_id, changed_ts, step, t.value - prior.value as moved,
                 row_number() over (partition by m.site_id, changed_ts, step order by abs(t.value - prior.value) desc, t.ts desc, t.row_id desc) as k
          from moves m join fx_thermometer t on t.site_id = m.site_id and t.ts >= changed_ts - 60 and t.ts <= changed_ts + 300
          where prior is not null and changed_ts - prior.ts <= 1860) q where k = 1""")


def judged(fx):
    return offset.judged_changes(of_sensor(fx), fx.fx_thermometer)


@query("offset_changes", f"select site_id, sensor, changed_ts, {r('step')} as step, {r('moved')} as moved, verdict from judged_moves")
def offset_changes(fx):
    return judged(fx)


part("directions", """
    select site_id, sensor, added, subtracted, unmoved,
           case when added + subtracted = 0 then case when unmoved > 0 then 'unmoved' else 'untested' end
                when subtracted = 0 then 'added' when added = 0 then 'subtracted' else 'mixed' end as "check"
    from (select s.site_id, s.sensor, count(*) filter (verdict = 'added') as added, count(*) filter (verdict = 'subtracted') as subtracted,
                 count(*) filter (verdict = 'unmoved') as unmoved
          from (select distinct site_id, sensor from fx_thermometer) s left join judged_moves using (site_id, sensor) group by all) q""")


@query("offset_direction", """select *, case when "check" = 'subtracted' then -1 else 1 end as sign from directions""")
def offset_direction(fx):
    return offset.offset_direction(judged(fx), fx.fx_thermometer)


# Site 3 has no setting, site 4 two, site 5 one without a history.
part("offered", """
    select distinct site_id, 'number.s' || site_id || '_temperature_offset' as setting from fx_thermometer where site_id <> 3
    union all select distinct site_id, 'number.s' || site_id || '_local_calibration' from fx_thermometer where site_id = 4""")


@query("offset_findings", """
    select t.site_id, t.sensor, case when o.n is null then 'none' when o.n > 1 then 'ambiguous' when h.first_ts is null then 'unrecorded' else 'corrected' end as finding,
           case when o.n = 1 then o.setting end as setting,
           case when o.n = 1 and h.first_ts is not null then d."check" end as "check",
           case when o.n = 1 and t.first_ts < h.first_ts then h.first_ts end as assumed_before
    from (select site_id, sensor, min(start_ts) as first_ts from thermometer_samples group by all) t
    left join (select site_id, count(*) as n, min(setting) as setting from offered group by site_id) o using (site_id)
    left join (select site_id, min(ts) as first_ts from setting_steps group by site_id) h using (site_id)
    left join directions d on d.site_id = t.site_id""")
def offset_findings(fx):
    sensors = fx.fx_thermometer.select(*SENSOR).distinct()
    plain = F.concat(F.lit("number.s"), F.col("site_id").cast("string"))
    first = sensors.filter("site_id <> 3").select("site_id", F.concat(plain, F.lit("_temperature_offset")).alias("setting"))
    second = sensors.filter("site_id = 4").select("site_id", F.concat(plain, F.lit("_local_calibration")).alias("setting"))
    matches = offset.match_settings(sensors, first.unionByName(second))
    directions = offset.offset_direction(judged(fx), sensors)
    return offset.offset_findings(sensors, matches, spans(fx), directions, samples(fx))
