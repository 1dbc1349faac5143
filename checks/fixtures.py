"""Sensor-like inputs from the given tables, the same text for Spark and for the SQL oracle.

``{EP}`` is the real epoch second of ``ts``, ``{DS}`` the epoch second of a date ``d``.
One site comes out of the data as a remainder by 1, so that its key is not folded to a constant.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TZ = "Europe/Berlin"

SPARK = {
    "EP": "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / cast(1000000 as double))",
    "DS": "(cast(unix_date(d) as bigint) * 86400)",
    "FLOOR": "cast(floor({0}) as bigint)",
    "SITES": "explode(sequence(0, 4))",
    "HOURS": "explode(sequence(0, 23))",
}
DUCK = {
    "EP": "(epoch_us(ts) / 1000000.0::double)",
    "DS": "cast(epoch(d) as bigint)",
    "FLOOR": "cast(floor({0}) as bigint)",
    "SITES": "unnest(generate_series(0, 4))",
    "HOURS": "unnest(generate_series(0, 23))",
}

ORDER_DAYS = """
    select cast(o_orderdate as date) as d, max(dayofyear(cast(o_orderdate as date))) as doy,
           avg(o_totalprice) as p, count(*) as n
    from {orders} group by cast(o_orderdate as date)"""
SEASONAL = (
    "9.5 + 9.5 * cos((doy - 197) / cast(365.25 as double) * 2 * pi())"
    " + (p / cast(50000 as double) - 5)"
)

TEXT = {
    # Irregular readings; an error row is "unavailable".
    "fx_readings": """
        select user_id % 2 as site_id, user_id % 4 as series_id, event_id as row_id, {EP} as ts,
               case when event_type = 'error' then null else value * 20 end as value
        from {events}""",
    # Two directions of power per site.
    "fx_grid": """
        select user_id % 3 as site_id,
               case when event_type in ('view', 'click') then 'import' else 'export' end as role,
               event_id as row_id, {EP} as ts, value * 20 as value
        from {events} where event_type <> 'error'""",
    # Intervals over several years, clock changes included.
    "fx_spans": """
        select cast(o_orderkey % 1 as int) as site_id, o_orderkey % 3 as series_id, o_orderkey as id,
               {DS} + (o_orderkey * 7919) % 86400 as start_ts,
               {DS} + (o_orderkey * 7919) % 86400 + (o_custkey * 61) % 20000 + 1 as end_ts,
               o_totalprice / cast(100 as double) as value
        from (select *, cast(o_orderdate as date) as d from {orders}) q""",
    "fx_outside": "select cast(n % 1 as int) as site_id, {DS} as start_ts, {DS} + 86400 as end_ts, "
    + SEASONAL
    + " as value from (" + ORDER_DAYS + ") q",
    "fx_rooms": """
        select cast(length(o_orderpriority) % 1 as int) as site_id, o_orderpriority as sensor, {DS} as start_ts, {DS} + 86400 as end_ts,
               cast(20 as double) + (p / cast(97003 as double) - cast(2.5 as double)) as value
        from (select o_orderpriority, cast(o_orderdate as date) as d, avg(o_totalprice) as p
              from {orders} group by o_orderpriority, cast(o_orderdate as date)) q""",
    # A running total read at midnight.
    "fx_meter": """
        select cast(n % 1 as int) as site_id, {DS} + 86400 as ts,
               sum(2 * greatest(cast(0 as double), 15 - (""" + SEASONAL + """)) + 10 + n % 5)
                 over (order by d rows between unbounded preceding and current row) as total
        from (""" + ORDER_DAYS + """) q""",
    # Raw recorder tables: 25 series, of five units; some known only to some tables.
    "fx_meta": """
        select n_nationkey % 2 as site_id, cast(n_nationkey as bigint) as metadata_id,
               'sensor.' || lower(n_name) || case n_nationkey % 5 when 2 then '_temperature'
                 when 3 then '_energy' else '_power' end as series_id,
               case n_nationkey % 5 when 0 then 'W' when 1 then 'kW' when 2 then '°C'
                 when 3 then 'kWh' else null end as unit
        from {nation}""",
    "fx_statistics": """
        select (user_id % 25) % 2 as site_id, user_id % 25 as metadata_id,
               cast(hour_ts as double) as start_ts,
               case when user_id % 5 <> 3 then avg(case when event_type <> 'error' then value * 20 end) end as mean,
               case when user_id % 5 <> 3 then min(case when event_type <> 'error' then value * 20 end) end as min,
               case when user_id % 5 <> 3 then max(case when event_type <> 'error' then value * 20 end) end as max,
               case when user_id % 5 = 3 then max(value) end as state,
               case when user_id % 5 = 3 then sum(value) end as sum
        from (select *, {HOUR_TS} as hour_ts from {events}) q
        where user_id % 25 < 15 group by user_id % 25, user_id % 5, hour_ts""",
    "fx_short": """
        select (user_id % 25) % 2 as site_id, user_id % 25 as metadata_id,
               cast(slot_ts as double) as start_ts,
               avg(case when event_type <> 'error' then value * 20 end) as mean
        from (select *, {FIVE_TS} as slot_ts from {events}) q
        where user_id % 25 < 20 group by user_id % 25, slot_ts""",
    "fx_states": """
        select (e.user_id % 25) % 2 as site_id, m.series_id, e.row_id, e.ts, e.state
        from (select user_id, event_id as row_id, {EP} as ts,
                     case event_id % 11 when 0 then 'unavailable' when 1 then ' ' || cast(value as {STR}) || ' '
                       when 2 then cast(value as {STR}) || 'd' when 3 then 'inf'
                       else cast(value as {STR}) end as state
              from {events}) e
        join (""" + "{META}" + """) m on m.metadata_id = e.user_id % 25
        where e.user_id % 25 < 23""",
    "fx_entities": """
        select n_nationkey % 3 as site_id,
               'sensor.' || lower(n_name) || case when n_nationkey % 4 = 3 then '' else '_local_temperature' end as sensor,
               'number.' || lower(n_name) || case n_nationkey % 3
                   when 0 then '_temperature_offset' when 1 then '_local_temperature_calibration'
                   else '_2_temperature_offset' end as setting
        from {nation}""",
    # Thermometers with an offset setting: one sensor and one setting per site, changed now and then.
    "fx_thermometer": """
        select user_id % 6 as site_id, 'sensor.s' || user_id % 6 || '_temperature' as sensor, event_id as row_id,
               {WHOLE} as ts, 18 + value / cast(50 as double) as value
        from {events}""",
    "fx_settings": """
        select user_id % 6 as site_id, 'number.s' || user_id % 6 || '_temperature_offset' as setting, event_id as row_id,
               {WHOLE} as ts, cast(floor(value / 3) as int) % 4 - cast(1.5 as double) as value
        from {events} where event_type = 'error' and user_id % 6 < 5""",
}
# Recorder tables of five houses, from the days of the orders. Outside: hourly statistics in °F, in K at one
# site. The meter: statistics at the end of a day in Wh or MWh, one with a change of meter, a stretch without
# readings at one site, raw states at another. Rooms: raw states twice a day.
HOUSE_DAYS = "(select {SITES} as site_id, q.* from (" + ORDER_DAYS + ") q)"
HOUSE_OUTSIDE = SEASONAL + " + site_id * cast(0.4 as double)"
OFFSET_NOW = "((extract(year from d) * 12 + extract(month from d)) % 4 - cast(1.5 as double))"
TEXT["fx_house_meta"] = """
    select cast(s as int) as site_id, cast(k as bigint) as metadata_id, 'sensor.' || case k when 1 then 'outside' else 'heat_energy' end as series_id,
           case when k = 1 then case s when 2 then 'K' else '°F' end else case s when 3 then 'MWh' when 0 then 'kWh' else ' Wh ' end end as unit
    from (select s, case length(r_name) % 2 when 0 then 1 else 2 end as k
          from (select {SITES} as s, r_name from {region}) q group by 1, 2) z"""
TEXT["fx_house_total"] = (
    "select site_id, d, total - case when site_id = 1 and d >= date'1996-06-01' then 4000 else 0 end as total from (select site_id, d, n, "
    "sum(2 * greatest(cast(0 as double), 15 - (" + HOUSE_OUTSIDE + ")) + 10 + n % 5) over (partition by site_id order by d "
    "rows between unbounded preceding and current row) as total from " + HOUSE_DAYS + " h) t "
    "where not (site_id = 2 and d between date'1996-06-10' and date'1996-09-05')"
)
TEXT["fx_house_statistics"] = (
    "select site_id, cast(1 as bigint) as metadata_id, cast({DS} + h * 3600 as double) as start_ts, "
    "case site_id when 2 then c + cast(273.15 as double) else c * cast(1.8 as double) + 32 end as mean, cast(null as double) as state from (select site_id, d, {HOURS} as h, "
    + HOUSE_OUTSIDE + " as c from " + HOUSE_DAYS + " h) o union all "
    "select site_id, 2, cast({DS} + 82800 as double), cast(null as double), total * case site_id when 3 then cast(0.001 as double) when 0 then 1 else 1000 end from ("
    + TEXT["fx_house_total"] + ") m where site_id <> 4"
)
TEXT["fx_house_states"] = (
    """
    select site_id, series_id, row_number() over (partition by site_id, series_id order by ts) as row_id, cast(ts as double) as ts, state from (
      select site_id, 'sensor.r' || k || '_temperature' as series_id, {DS} + half * 1100 as ts,
             cast(20 + site_id * cast(0.25 as double) + (p / cast(97003 as double) - cast(2.5 as double))
                  + case when half = 1 and k = '1' then (case when site_id % 2 = 0 then 1 else -1 end) * case when """ + OFFSET_NOW + """ < -1 then -3 else 1 end
                         else 0 end as {STR}) as state
      from (select {SITES} as site_id, k, d, p, half from (
              select k, d, p, 0 as half from (select substr(o_orderpriority, 1, 1) as k, cast(o_orderdate as date) as d, avg(o_totalprice) as p from {orders} group by 1, 2) a
              union all
              select k, d, p, 1 as half from (select substr(o_orderpriority, 1, 1) as k, cast(o_orderdate as date) as d, avg(o_totalprice) as p from {orders} group by 1, 2) b) u) v
      union all
      select site_id, name, {DS} + 1000, case when name like '%3%' then 'unavailable' else cast(""" + OFFSET_NOW + """ as {STR}) end
      from (select site_id, d, name from (select h.*, """
    + "{EACH}(" + ", ".join(f"'number.r{n}'" for n in ("1_temperature_offset", "2_temperature_offset", "2_local_calibration", "3_temperature_offset")) + "{END} as name from "
    + HOUSE_DAYS + " h) w) n union all select site_id, 'sensor.heat_energy', {DS} + 86400, cast(total as {STR}) from ("
    + TEXT["fx_house_total"] + ") m where site_id = 4) s"
)
# Whole tables in place of the fixtures above that leave rows out. An error ends what both directions hold.
WHOLE = {
    "fx_grid": """
        select user_id % 3 as site_id,
               case when event_type in ('view', 'click') then 'import' else 'export' end as role,
               event_id as row_id, {EP} as ts, value * 20 as value
        from {events} where event_type <> 'error'
        union all
        select user_id % 3, 'import', event_id, {EP}, cast(null as double) from {events} where event_type = 'error'
        union all
        select user_id % 3, 'export', event_id, {EP}, cast(null as double) from {events} where event_type = 'error'""",
    "fx_statistics": TEXT["fx_statistics"].replace("where user_id % 25 < 15 ", ""),
    "fx_short": TEXT["fx_short"].replace("where user_id % 25 < 20 ", ""),
    "fx_states": TEXT["fx_states"].replace("where e.user_id % 25 < 23", ""),
    "fx_settings": TEXT["fx_settings"].replace("where event_type = 'error' and user_id % 6 < 5", ""),
}
# The same total with a change of meter (a fall) and a stretch without readings (unchanged months).
TEXT["fx_meter_flawed"] = (
    "select site_id, ts, case when ts >= 930000000 then total - 15000 else total end as total from ("
    + TEXT["fx_meter"]
    + ") m where not (ts between 830000000 and 837000000)"
)


def _fill(text: str, dialect: dict[str, str], tables: dict[str, str]) -> str:
    ep = dialect["EP"]
    whole = dialect["FLOOR"].format(ep)
    names = {
        **tables,
        "EP": ep,
        "DS": dialect["DS"],
        "HOUR_TS": f"({whole} - {whole} % 3600)",
        "FIVE_TS": f"({whole} - {whole} % 300)",
        "WHOLE": whole,
        **{k: dialect[k] for k in ("STR", "SITES", "HOURS", "EACH", "END")},
        "META": TEXT["fx_meta"],
    }
    for _ in range(2):
        for name, value in names.items():
            text = text.replace("{" + name + "}", value)
    return text


SPARK |= {"STR": "string", "EACH": "explode(array", "END": "))"}
DUCK |= {"STR": "varchar", "EACH": "unnest(list_value", "END": "))"}
TABLES = ("events", "orders", "nation", "region", "supplier", "lineitem")


def duck(name: str, text: str | None = None) -> str:
    """A fixture as a SELECT for the oracle."""
    return _fill(text or TEXT[name], DUCK, {t: t for t in TABLES})


# The five order priorities as rooms on two floors.
ROOMS = (
    (0, "Ground", 0, "Living", "1-URGENT", 32.0),
    (0, "Ground", 1, "Kitchen", "2-HIGH", 14.0),
    (0, "Ground", 2, "Bath", "3-MEDIUM", 12.0),
    (1, "Upper", 0, "Bedroom", "4-NOT SPECIFIED", 18.0),
    (1, "Upper", 1, "Study", "5-LOW", 8.0),
)
# The same sensors with two in one room, for the means of a group.
SHARED_ROOMS = (
    (0, "Ground", 0, "Living", "1-URGENT", 32.0),
    (0, "Ground", 0, "Living", "2-HIGH", 32.0),
    (0, "Ground", 1, "Bath", "3-MEDIUM", 12.0),
    (1, "Upper", 0, "Bedroom", "4-NOT SPECIFIED", None),
    (1, "Upper", 0, "Bedroom", "5-LOW", None),
)
TOTAL_AREA = 120.0
ROOM_SCHEMA = "floor_pos int, floor string, room_pos int, room string, sensor string, area double"


def rooms_sql(rooms=ROOMS) -> str:
    """The rooms dimension as VALUES for the oracle."""
    rows = ", ".join(
        f"({fp}, '{f}', {rp}, '{r}', '{s}', {'null' if a is None else f'{a}::double'})"
        for fp, f, rp, r, s, a in rooms
    )
    return (
        "select 0 as site_id, * from (values " + rows + ") v(floor_pos, floor, room_pos, room, sensor, area)"
    )


class Fixtures:
    """The adapters over one scale factor's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, other: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.texts = spark, sf_dir, TEXT | (other or {})

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if not name.startswith("fx_"):
            raise AttributeError(name)
        text = _fill(self.texts[name], SPARK, {})
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def _rooms(self, rooms) -> DataFrame:
        # The sensors come from the orders; only their place in the house is written here.
        priorities = self.table("orders").select(F.col("o_orderpriority").alias("sensor")).distinct()
        places = F.array(
            *[
                F.struct(
                    F.lit(fp).alias("floor_pos"), F.lit(f).alias("floor"), F.lit(rp).alias("room_pos"),
                    F.lit(r).alias("room"), F.lit(s).alias("of"), F.lit(a).cast("double").alias("area"),
                )
                for fp, f, rp, r, s, a in rooms
            ]
        )
        return (
            priorities.withColumn("place", F.explode(places))
            .filter("place.of = sensor")
            .select((F.length("sensor") % 1).alias("site_id"), "place.floor_pos", "place.floor", "place.room_pos", "place.room", "sensor", "place.area")
        )

    @cached_property
    def rooms(self) -> DataFrame:
        return self._rooms(ROOMS)

    @cached_property
    def shared_rooms(self) -> DataFrame:
        return self._rooms(SHARED_ROOMS)

    @cached_property
    def houses(self) -> DataFrame:
        return self.rooms.select("site_id").distinct().select(
            "site_id", F.lit(None).cast("double").alias("heated_area"), F.lit(TOTAL_AREA).alias("total_area")
        )
