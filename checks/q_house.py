"""The heating report from the recorder tables of five houses: one query for each of its tables."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import q_heating, q_offset  # noqa: F401
from checks.fixtures import TZ, Fixtures
from checks.q_grid import local
from checks.q_recorded import given, reported
from checks.registry import CTES, r
from holdspan import KEYS
from holdspan.operators.settle import settled
from holdspan.options import ReadOptions
from holdspan.plans.heating import recorded_heating
from holdspan.sources.load import Tables

# A reading of a room holds for up to twenty days; a hole of two days outside is an outage.
READ = ReadOptions(tz=TZ, max_gap=20 * 86_400, gap_threshold=2 * 86_400)
# Five rooms on two floors, the same in every house.
PLACES = ((0, "Ground", 0, "Living", 1, 32.0), (0, "Ground", 1, "Kitchen", 2, 14.0), (0, "Ground", 2, "Bath", 3, 12.0),
          (1, "Upper", 0, "Bedroom", 4, 18.0), (1, "Upper", 1, "Study", 5, 8.0))
TOTAL_AREA = 120.0


def rooms(states):
    """The sensors come from the states; only their place in the house is written here. The last house names no rooms."""
    sensor = F.regexp_extract("series_id", r"^sensor\.r(\d)_", 1)
    known = states.select("site_id", F.col("series_id").alias("sensor"), sensor.try_cast("int").alias("k"))
    names = ("floor_pos", "floor", "room_pos", "room", "of", "area")
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, place)]) for place in PLACES])
    known = known.filter("k is not null and site_id < 4").distinct()
    return known.withColumn("place", F.explode(places)).filter("place.of = k").select("site_id", "place.*", "sensor").drop("of")


@lru_cache(maxsize=1)
def made(application: str, sf_dir: str):
    """The report of a session, settled once for the queries on its tables."""
    spark = SparkSession.getActiveSession()
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="house-"))
    return house(Fixtures(spark, sf_dir))


def house(fx):
    # A recorder's tables are stored; these come from all orders, which every branch of the report would read again.
    meta, states = fx.fx_house_meta, settled(fx.fx_house_states)
    statistics = settled(fx.fx_house_statistics)
    none = statistics.filter("metadata_id is null")
    dim = rooms(states)
    houses = dim.select("site_id").distinct().select("site_id", F.lit(None).cast("double").alias("heated_area"), F.lit(TOTAL_AREA).alias("total_area"))
    named = meta.unionByName(states.select("site_id", F.lit(None).cast("bigint").alias("metadata_id"), "series_id", F.lit(None).cast("string").alias("unit")))
    outside = meta.filter("series_id = 'sensor.outside'").select(*KEYS)
    meters = named.filter("series_id = 'sensor.heat_energy'").select(*KEYS).distinct()
    return recorded_heating(outside, meters, Tables(meta, statistics, none, states), dim, houses, READ, floors=2)


# The loads in SQL, in place of the fixtures that the oracles of the operators read.
FIRST = "sensor.r1_temperature"
LOADED = {
    "fx_outside": """
    select site_id, cast(start_ts as bigint) as start_ts, cast(start_ts as bigint) + 3600 as end_ts,
           case when site_id = 2 then mean - 273.15::double else (mean - 32) * 5.0::double / 9.0::double end as value
    from fx_house_statistics where metadata_id = 1""",
    "fx_meter_flawed": """
    select s.site_id, cast(start_ts as bigint) + 3600 as ts, state * case trim(unit) when 'Wh' then 0.001::double when 'MWh' then 1000 else 1 end as total
    from fx_house_statistics s join fx_house_meta m on m.site_id = s.site_id and m.metadata_id = s.metadata_id where s.metadata_id = 2 and s.site_id < 4
    union all select site_id, cast(ts as bigint), cast(state as double) from fx_house_states where series_id = 'sensor.heat_energy'""",
    "fx_settings": """
    select site_id, series_id as setting, row_id, cast(ts as bigint) as ts, cast(state as double) as value
    from fx_house_states where series_id = 'number.r1_temperature_offset'""",
    "fx_thermometer": f"""
    select site_id, series_id as sensor, row_id, cast(ts as bigint) as ts, cast(state as double) as value from fx_house_states where series_id = '{FIRST}'""",
    "judged_moves": CTES["judged_moves"].replace("'sensor.s' || site_id || '_temperature'", f"'{FIRST}'"),
    "house_samples": """
    select site_id, sensor, start_ts, least(coalesce(nxt, start_ts + 1728000), start_ts + 1728000) as end_ts, value
    from (select site_id, series_id as sensor, cast(ts as bigint) as start_ts, cast(state as double) as value,
                 lead(cast(ts as bigint)) over (partition by site_id, series_id order by ts) as nxt
          from fx_house_states where series_id like 'sensor.r%' and site_id < 4) q""",
    "fx_rooms": f"""
    select s.site_id, s.sensor, greatest(start_ts, from_ts) as start_ts, least(end_ts, to_ts) as end_ts,
           value - degrees * case when "check" = 'subtracted' then -1 else 1 end as value
    from house_samples s join setting_spans p on p.site_id = s.site_id and least(end_ts, to_ts) > greatest(start_ts, from_ts)
    join directions d on d.site_id = s.site_id where s.sensor = '{FIRST}'
    union all select site_id, sensor, start_ts, end_ts, value from house_samples where sensor <> '{FIRST}'""",
    "dim_rooms": "select site_id, v.* from (select distinct site_id from fx_house_meta where site_id < 4) s, (values "
    + ", ".join(f"({fp}, '{f}', {rp}, '{n}', 'sensor.r{k}_temperature', {a}::double)" for fp, f, rp, n, k, a in PLACES)
    + ") v(floor_pos, floor, room_pos, room, sensor, area)",
    # The house by all its rooms, weighted by area, from their hours: the whole chain to the heat loss.
    "one_room": CTES["five_hours"],
}
LOST = """
    select site_id, until as start_ts, start_ts as end_ts, start_ts - until as seconds
    from (select site_id, start_ts, max(end_ts) over (partition by site_id order by start_ts rows between unbounded preceding and 1 preceding) as until
          from fx_outside) q where start_ts - until >= 172800"""
COVERAGE = f"""
    select *, observed_days / span_days::double as day_fraction, span_days >= 365 as full_year,
           least(missing_seconds / (span_days * 86400.0::double), 1) as missing_fraction
    from (select site_id, first_ts, last_ts, date_diff('day', first_day, last_day) + 1 as span_days, n as observed_days, full_days, observed_seconds,
                 coalesce(outages, 0) as outages, coalesce(missing_seconds, 0) as missing_seconds, longest as longest_outage
          from (select site_id, min(start_ts) as first_ts, max(end_ts) as last_ts, cast(sum(end_ts - start_ts) as bigint) as observed_seconds,
                       cast({local('min(start_ts)')} as date) as first_day, cast({local('max(end_ts) - 1')} as date) as last_day from fx_outside group by site_id) s
          join (select site_id, count(*) as n, count(*) filter (covered_seconds >= 72000) as full_days from outside_days group by site_id) d using (site_id)
          left join (select site_id, count(*) as outages, cast(sum(seconds) as bigint) as missing_seconds, max(seconds) as longest from ({LOST}) l group by site_id) o using (site_id)) c"""
FLOOR_JOIN = " and ".join(f"{{f}}.{c} is not distinct from p.{c}" for c in ("site_id", "grain", "year", "part"))


def floor_join(i: int) -> str:
    return f"left join floor_periods f{i} on f{i}.floor_pos = {i} and " + FLOOR_JOIN.format(f=f"f{i}")


LOSS_COLUMNS = ("site_id", "month", "heating_kwh", "hours", "counted_hours", "house_sum", "not_counted")
TABLES = {
    "outside_days": f"select site_id, cast(day as varchar) as day, {r('mean')} as mean, covered_seconds, day_seconds from outside_days",
    "periods": given("period_summary"),
    "rooms": given("room_means"),
    "floors": given("floor_means"),
    "period_table": given("period_report").split("from periods p")[0] + "from periods p " + floor_join(0) + " " + floor_join(1),
    "coldest": f"""
    select site_id, grain, year, part, days, {r('hdd')} as hdd from periods where grain = 'month' and hdd > 0
    qualify row_number() over (partition by site_id order by hdd desc, year desc, part desc) = 1""",
    "partial_days": "select site_id, floor_pos, room_pos, count(*) as partial_days from room_days where partial group by all",
    "outages": LOST,
    "coverage": f"""
    select site_id, first_ts, last_ts, span_days, observed_days, full_days, observed_seconds, outages, missing_seconds, longest_outage,
           {r('day_fraction')} as day_fraction, {r('missing_fraction')} as missing_fraction, full_year,
           observed_days < 30 or missing_fraction > 0.15 as sparse, not full_year or observed_days < 30 or missing_fraction > 0.15 as caution
    from ({COVERAGE}) c""",
    "base_load": f"select site_id, {r('avg(per_month)')} as base_per_month from own_load group by site_id",
    "months": given("month_report"),
    "seasons": given("season_report"),
    "efficiency": given("efficiency"),
    "loss_months": f"""
    select site_id, cast(month as varchar) as month, {r('heating_kwh')} as heating_kwh, hours, counted_hours, {r('house_sum', 4)} as house_sum, not_counted
    from one_loss_months""",
    "losses": given("heat_loss"),
    "causes": given("change_cause"),
    "warmer": given("degree_warmer").replace(
        "(select season from losses where season is not null and heating_months > 0 order by heating_months desc, season desc limit 1)",
        "(select max_by(season, heating_months * 10000 + season) from losses x where x.site_id = l.site_id and season is not null and heating_months > 0)",
    ),
    "benchmark": given("per_square_metre").replace("from years where", "from years where site_id in (select site_id from dim_rooms) and").replace("latest or season is not null", "(latest or season is not null)"),
    "findings": f"""
    select t.site_id, t.sensor, case substr(t.sensor, 9, 1) when '1' then 'corrected' when '2' then 'ambiguous' when '3' then 'unrecorded' else 'none' end as finding,
           case substr(t.sensor, 9, 1) when '1' then 'number.r1_temperature_offset' when '3' then 'number.r3_temperature_offset' end as setting,
           case when t.sensor = '{FIRST}' then d."check" end as "check", case when t.sensor = '{FIRST}' and t.first_ts < h.first_ts then h.first_ts end as assumed_before
    from (select site_id, sensor, min(start_ts) as first_ts from house_samples group by all) t
    left join directions d on d.site_id = t.site_id left join (select site_id, min(ts) as first_ts from setting_steps group by site_id) h on h.site_id = t.site_id""",
    "readiness": """
    select m.site_id, v.* from (select distinct site_id from fx_house_meta) m, (values ('building_or_behaviour', 'rooms'), ('building_or_behaviour', 'room_areas'),
      ('degree_warmer', 'rooms'), ('degree_warmer', 'room_areas'), ('benchmark', 'rooms'), ('benchmark', 'heated_area'), ('indoor_temperatures', 'rooms')) v(section, need)
    where m.site_id not in (select site_id from dim_rooms)""",
    "provenance": f"""
    select site_id, 'sensor.outside' as series_id, 'statistics' as source, case when site_id = 2 then 'K' else '°F' end as unit,
           {r('case when site_id = 2 then 1 else 5 / 9.0::double end')} as scale, {r('case when site_id = 2 then -273.15::double else -160 / 9.0::double end')} as "offset",
           count(*) as samples, min(start_ts) as first_ts, max(end_ts) as last_ts from fx_outside group by site_id
    union all select site_id, sensor, 'states', null, 1, 0, count(*), min(start_ts), max(end_ts) from house_samples where end_ts > start_ts group by site_id, sensor""",
    "meters": """
    select distinct site_id, 'sensor.heat_energy' as series_id, case when site_id = 4 then 'states' else 'statistics' end as source,
           case when site_id < 4 then unit end as unit, case when site_id = 4 then 1.0::double else case trim(unit) when 'Wh' then 0.001::double when 'MWh' then 1000 else 1 end end as scale
    from fx_house_meta where metadata_id = 2""",
}
CHOSEN = {
    "coldest": ("site_id", "grain", "year", "part", "days", "hdd"),
    "losses": ("season", "heating_months", "heating_hours", "sound_kwh", "loss_slope", "watts_per_kelvin", "r2", "slope_error", "house", "free_heat_watts", "site_id"),
    "efficiency": ("site_id", "season", "months", "fitted", "sound_kwh", "slope", "base", "r2", "slope_error", "points"),
    "loss_months": LOSS_COLUMNS,
    "benchmark": ("site_id", "first_month", "latest", "label", "per_heated", "heated_class", "per_total", "total_class"),
    "coverage": ("site_id", "first_ts", "last_ts", "span_days", "observed_days", "full_days", "observed_seconds", "outages", "missing_seconds",
                 "longest_outage", "day_fraction", "missing_fraction", "full_year", "sparse", "caution"),
}


def table(name: str):
    def build(fx):
        out = made(fx.spark.sparkContext.applicationId, fx.sf_dir)[name]
        if name == "loss_months":
            out = out.withColumn("house_sum", F.round("house_sum", 4))
        return {name: out.select(*CHOSEN[name]) if name in CHOSEN else out}

    return build


for name, sql in TABLES.items():
    reported(f"recorded_heating_{name}", name, table(name), sql, other=LOADED)
