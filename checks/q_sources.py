"""Queries over scans, units, the catalogue and suggestions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from checks.q_grid import JAN
from checks.registry import part, query, r
from holdspan.functions import values as V
from holdspan.operators import intervals
from holdspan.options import ReadOptions
from holdspan.sources import catalog, load, normalise, sink

KEYS = ("site_id", "series_id")
WHOLE = "cast(floor(epoch_us(ts) / 1000000.0::double) as bigint)"


# ---- layouts ---------------------------------------------------------------------------------
@query("recorder_source", f"""
    select 'sensor.' || event_type as series_id, event_id as row_id, cast(value as varchar) as state, {WHOLE} as ts
    from events where event_type in ('view', 'click') and {WHOLE} >= {JAN + 5 * 86400} and {WHOLE} < {JAN + 9 * 86400}""")
def recorder_source(fx):
    """Landed states: series and time go down to the Parquet scan."""
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = fx.table("events").filter(F.col("event_type").isin("view", "click"))
    rows = rows.filter(
        (F.col("ts") >= day + F.expr("interval 5 days")) & (F.col("ts") < day + F.expr("interval 9 days"))
    )
    landed = rows.select(
        F.concat(F.lit("sensor."), "event_type").alias("entity_id"),
        F.col("event_id").alias("state_id"),
        F.col("value").cast("string").alias("state"),
        F.col("ts").cast("string").alias("last_updated"),
    )
    out = normalise.normalise_states(landed)
    return out.select("series_id", "row_id", "state", V.floor_timestamp(F.col("ts")).alias("ts"))


def legacy(fx):
    """The older layout: text times, and ids named by a meta table without a unit."""
    rows = fx.table("events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 25).alias("metadata_id"),
        F.col("ts").cast("string").alias("start"),
        F.col("value").alias("mean"),
    )
    meta = fx.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("statistic_id")
    )
    return normalise.normalise_statistics(rows, meta)


@query("normalise_recorder", f"""
    select n_name as series_id, {WHOLE} as start_ts, {r('value')} as mean from events join nation on n_nationkey = user_id % 25""")
def normalise_recorder(fx):
    out = legacy(fx)
    return out.select("series_id", V.floor_timestamp(F.col("start_ts")).alias("start_ts"), "mean")


part("named_statistics", """
    select m.site_id, m.series_id, m.unit, s.start_ts, s.mean, s.min, s.max, s.state, s.sum
    from fx_statistics s join fx_meta m using (site_id, metadata_id)""")


def statistics(fx):
    return fx.fx_statistics.join(fx.fx_meta, ["site_id", "metadata_id"])


@query("statistics_samples", f"""
    select site_id, series_id, greatest(cast(start_ts as bigint), {JAN + 86400 + 600}) as start_ts,
           least(cast(start_ts as bigint) + 3600, {JAN + 9 * 86400 + 777}) as end_ts, {r('max')} as value
    from named_statistics where max is not null and start_ts + 3600 > {JAN + 86400 + 600} and start_ts < {JAN + 9 * 86400 + 777}""")
def statistics_samples(fx):
    return intervals.statistics_samples(statistics(fx), "max", 3_600, JAN + 86400 + 600, JAN + 9 * 86400 + 777)


@query("counter_readings", f"""
    select site_id, series_id, cast(start_ts as bigint) + 3600 as ts, {r('coalesce(state, mean)')} as total
    from named_statistics where coalesce(state, mean) is not null""")
def counter_readings(fx):
    return intervals.counter_readings(statistics(fx))


NUMBER = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
PARSED = f"case when regexp_matches(trim(state), {NUMBER}) then try_cast(trim(state) as double) end"


@query("setting_history", f"""
    select site_id, series_id, cast(floor(ts) as bigint) as ts, row_id, {r(PARSED)} as value from fx_states where {PARSED} is not null""")
def setting_history(fx):
    return intervals.setting_history(fx.fx_states)


# ---- values ----------------------------------------------------------------------------------
@query("parse_value", f"select row_id, {r(PARSED)} as value from fx_states")
def parse_value(fx):
    return fx.fx_states.select("row_id", V.parse_value(F.col("state")).alias("value"))


@query("parse_timestamp", f"""
    select event_id, case event_id % 7 when 5 then null when 6 then {WHOLE} - {WHOLE} % 60 when 3 then {WHOLE} - 7200 else {WHOLE} end as ts from events""")
def parse_timestamp(fx):
    text = F.col("ts").cast("string")
    form = F.col("event_id") % 7
    shown = (
        F.when(form == 0, text)
        .when(form == 1, F.concat(F.regexp_replace(text, " ", "T"), F.lit("Z")))
        .when(form == 2, F.concat(F.lit(" "), F.regexp_replace(text, " ", "T"), F.lit("+00:00")))
        .when(form == 3, F.concat(text, F.lit("+02:00")))
        .when(form == 4, F.concat(F.substring(text, 1, 19), F.lit("Z")))
        .when(form == 5, F.concat(F.lit("at "), text))
        .otherwise(F.substring(text, 1, 16))
    )
    return fx.table("events").select("event_id", V.parse_timestamp(shown).alias("ts"))


UNITS = ("W", "kW", "MW", "mW", "°C", "°F", "K", "lx", " kW ")


@query("convert_units", f"""
    select event_id, case u when 0 then 'W' when 1 then 'kW' when 2 then 'MW' when 3 then 'mW' when 4 then '°C' when 5 then '°F'
                            when 6 then 'K' when 7 then 'lx' when 8 then ' kW ' end as unit, u not in (4, 5, 6) as ok,
           {r("value * case u when 1 then 1000 when 2 then 1000000 when 3 then 0.001::double when 8 then 1000 else 1 end")} as value
    from (select *, event_id % 10 as u from events) q""")
def convert_units(fx):
    unit = F.lit(None).cast("string")
    for i, name in enumerate(UNITS):
        unit = F.when(F.col("event_id") % 10 == i, name).otherwise(unit)
    rows = fx.table("events").select("event_id", unit.alias("unit"), "value")
    good, bad = V.convert_units(rows, "power")
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


@query("convert_temperature", f"""
    select event_id, {r("case event_id % 3 when 0 then value when 1 then (value - 32) * 5 / 9.0::double else value - 273.15::double end")} as value from events""")
def convert_temperature(fx):
    unit = F.element_at(F.array(F.lit("°C"), F.lit("°F"), F.lit("K")), (F.col("event_id") % 3).cast("int") + 1)
    rows = fx.table("events").select("event_id", unit.alias("unit"), "value")
    return V.convert_units(rows, "temperature")[0].drop("unit")


@query("clamp_negative", f"select event_id, {r('greatest(value - 30, 0)')} as value from events")
def clamp_negative(fx):
    return fx.table("events").select("event_id", V.clamp_negative(F.col("value") - 30).alias("value"))


@query("energy_scale", f"""
    select metadata_id, {r("case coalesce(unit, '') when 'kWh' then 1 when '' then 1 end")} as scale from fx_meta""")
def energy_scale(fx):
    return fx.fx_meta.select("metadata_id", V.energy_scale(F.col("unit")).alias("scale"))


# ---- catalogue -------------------------------------------------------------------------------
@query("series_matching", """
    select distinct site_id, series_id from fx_meta where series_id ilike 'sensor.%' and (series_id ilike '%TEMP%' or series_id ilike '%nation_1%')""")
def series_matching(fx):
    return catalog.series_matching(fx.fx_meta, "sensor", ("TEMP", "nation_1"))


part("requests", """
    select site_id, series_id from fx_meta union all select n_nationkey % 2, 'sensor.nobody_' || n_nationkey from nation where n_nationkey < 3""")


def requests(fx):
    nobody = fx.table("nation").filter("n_nationkey < 3").select(
        (F.col("n_nationkey") % 2).alias("site_id"),
        F.concat(F.lit("sensor.nobody_"), F.col("n_nationkey").cast("string")).alias("series_id"),
    )
    return fx.fx_meta.select(*KEYS).unionByName(nobody)


@query("resolve_source", """
    select q.site_id, q.series_id,
           case when exists (select 1 from fx_statistics s where s.metadata_id = m.metadata_id) then 'statistics'
                when exists (select 1 from fx_short s where s.metadata_id = m.metadata_id) then 'short_term'
                when exists (select 1 from fx_states s where s.site_id = q.site_id and s.series_id = q.series_id) then 'states' else 'statistics' end as source,
           exists (select 1 from fx_statistics s where s.metadata_id = m.metadata_id) or exists (select 1 from fx_short s where s.metadata_id = m.metadata_id)
             or exists (select 1 from fx_states s where s.site_id = q.site_id and s.series_id = q.series_id) as known
    from requests q left join fx_meta m on m.site_id = q.site_id and m.series_id = q.series_id""")
def resolve_source(fx):
    return catalog.resolve_source(requests(fx), fx.fx_meta, fx.fx_statistics, fx.fx_short, fx.fx_states)


part("resolved", """
    select q.site_id, q.series_id, m.metadata_id, m.unit,
           case when exists (select 1 from fx_statistics s where s.metadata_id = m.metadata_id) then 'statistics'
                when exists (select 1 from fx_short s where s.metadata_id = m.metadata_id) then 'short_term'
                when exists (select 1 from fx_states s where s.site_id = q.site_id and s.series_id = q.series_id) then 'states' else 'statistics' end as source
    from requests q left join fx_meta m on m.site_id = q.site_id and m.series_id = q.series_id""")
part("wanted_power", """
    select *, case unit when 'kW' then 1000.0::double else 1.0::double end as scale
    from resolved where unit is null or unit not in ('°C')""")
part("loaded_power", f"""
    with raw as (
      select w.site_id, w.series_id, cast(s.start_ts as bigint) as start_ts, cast(s.start_ts as bigint) + 3600 as end_ts, s.mean as value
      from fx_statistics s join wanted_power w using (metadata_id) where w.source = 'statistics' and s.mean is not null
      union all
      select w.site_id, w.series_id, cast(s.start_ts as bigint), cast(s.start_ts as bigint) + 300, s.mean
      from fx_short s join wanted_power w using (metadata_id) where w.source = 'short_term' and s.mean is not null
      union all
      select site_id, series_id, sec, least(coalesce(nxt, sec + 900), sec + 900), value
      from (select *, lead(sec) over (partition by site_id, series_id order by sec) as nxt
            from (select s.site_id, s.series_id, cast(floor(ts) as bigint) as sec, arg_max({PARSED}, (ts, row_id)) as value,
                         arg_max({PARSED} is null, (ts, row_id)) as gone
                  from fx_states s join wanted_power w on w.site_id = s.site_id and w.series_id = s.series_id and w.source = 'states'
                  group by all) a) b where not gone)
    select r.site_id, r.series_id, greatest(start_ts, {JAN + 86400}) as start_ts, least(end_ts, {JAN + 20 * 86400}) as end_ts,
           greatest(value * scale, 0) as value
    from raw r join wanted_power w using (site_id, series_id)
    where end_ts > {JAN + 86400} and start_ts < {JAN + 20 * 86400} and end_ts > start_ts""")


def loaded(fx):
    options = getattr(fx, "options", ReadOptions(from_ts=JAN + 86400, to_ts=JAN + 20 * 86400))
    tables = (fx.fx_meta, fx.fx_statistics, fx.fx_short, fx.fx_states)
    return load.load_samples(requests(fx), *tables, "power", options, clamp=True)


@query("load_samples", f"select site_id, series_id, start_ts, end_ts, {r('value')} as value from loaded_power")
def load_samples(fx):
    return loaded(fx).samples


@query("load_provenance", """
    select w.site_id, w.series_id, source, unit, scale, 0.0::double as "offset", coalesce(n, 0) as samples, first_ts, last_ts
    from wanted_power w left join (select site_id, series_id, count(*) as n, min(start_ts) as first_ts, max(end_ts) as last_ts
                                   from loaded_power group by all) l using (site_id, series_id)""")
def load_provenance(fx):
    return loaded(fx).provenance


@query("load_refused", "select site_id, series_id, source, unit from resolved where unit = '°C'")
def load_refused(fx):
    return loaded(fx).refused


@query("write_tables", f"select site_id, series_id, start_ts, end_ts, {r('value')} as value from loaded_power")
def write_tables(fx):
    """Loaded samples written to the shared folder and read back."""
    shared = fx.spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
    folder = f"{shared}/tables-{uuid.uuid4().hex}"
    sink.write_tables({"samples": loaded(fx).samples}, folder)
    return sink.read_table(fx.spark, folder, "samples")


part("cat", """
    select m.site_id, m.series_id, m.unit, coalesce(rows, 0) as rows, coalesce(means, 0) as means, coalesce(sums, 0) as sums, first_ts, last_ts
    from fx_meta m left join (select metadata_id, count(*) as rows, count(mean) as means, count(sum) as sums,
                                     cast(min(start_ts) as bigint) as first_ts, cast(max(start_ts) as bigint) as last_ts
                              from fx_statistics group by metadata_id) s using (metadata_id)""")
part("kinds", """
    select *, case when quantity = 'power' then 0 when quantity = 'temperature' then 1 when energy_counter then 2 else 3 end as rank_group
    from (select *, case when means > 0 and sums > 0 then 'mean_total' when means > 0 then 'mean' when sums > 0 then 'total' else 'empty' end as kind,
                 case when means > 0 and unit in ('W', 'kW') then 'power' when means > 0 and unit = '°C' then 'temperature' end as quantity,
                 sums > 0 and coalesce(unit like '%Wh', false) as energy_counter from cat) q""")


def listing(fx):
    return catalog.series_catalog(fx.fx_meta, fx.fx_statistics)


@query("series_catalog", "select * from cat")
def series_catalog(fx):
    return listing(fx)


@query("series_kind", "select * from kinds")
def series_kind(fx):
    return catalog.catalog_listing(listing(fx))


@query("value_count", """
    select site_id, series_id, count(*) as rows, count(mean) as "values" from named_statistics group by all""")
def value_count(fx):
    return catalog.value_count(statistics(fx), "mean")


@query("diagnose_empty", f"""
    select q.site_id, q.series_id, unit, rows, means, first_ts, last_ts,
           case when rows is null then 'unknown' when rows = 0 then 'no_rows' when means = 0 then 'no_values' else 'outside_window' end as reason
    from requests q left join cat using (site_id, series_id)
    where not exists (select 1 from named_statistics s where s.site_id = q.site_id and s.series_id = q.series_id and mean is not null
                      and start_ts + 3600 > {JAN + 40000} and start_ts < {JAN + 60000})""")
def diagnose_empty(fx):
    samples = intervals.statistics_samples(statistics(fx), "mean", 3_600, JAN + 40000, JAN + 60000)
    return catalog.diagnose_empty(requests(fx), listing(fx), samples)


@query("suggest_replacements", """
    select site_id, wanted, series_id, rows, shared, place from (
      select *, row_number() over (partition by site_id, wanted order by shared desc, rows desc, series_id) as place
      from (select w.site_id, w.series_id as wanted, k.series_id, k.rows,
                   (select max(i) from range(0, 60) t(i) where i <= length(w.series_id) and i <= length(k.series_id)
                      and left(w.series_id, i) = left(k.series_id, i)) as shared
            from requests w join kinds k on k.site_id = w.site_id where k.quantity = 'power') a) b where place <= 2""")
def suggest_replacements(fx):
    wanted = requests(fx).withColumnRenamed("series_id", "wanted")
    return catalog.suggest_replacements(wanted, listing(fx), "power", 2)


NEEDLES = ("sensor.nation_1_power", "nation_2", "sensor.attic_temperature", "x.zz")
PATTERNS = [(n, i, p) for n in NEEDLES for i, p in enumerate(catalog.id_patterns(n))]


@query("suggest_ids", """
    select site_id, needle, pattern, place, series_id from (
      select *, row_number() over (partition by site_id, needle order by series_id) as place
      from (select *, min(pattern) over (partition by site_id, needle) as best
            from fx_meta join (values """ + ", ".join(f"('{n}', {i}, '%{p}%')" for n, i, p in PATTERNS) + """) v(needle, pattern, p) on series_id ilike p) a
      where pattern = best) b where place <= 4""")
def suggest_ids(fx):
    return catalog.suggest_ids(fx.fx_meta, NEEDLES, 4)
