"""From recorder tables to samples in working units, with a table of where they came from.

The tables are read in two steps. The first reads ids alone and decides for each requested series: which
table answers for it, under which ids, and how its unit is converted. The decision has a row for each
request; settled, it is all that the second step needs, which reads each table once and only for the
series that it answers for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions.values import clamp_negative, conversion, energy_scale, finite, parse_value
from holdspan.operators.intervals import (
    STATISTICS_SECONDS,
    counter_readings,
    setting_history,
    state_samples,
    statistics_samples,
)
from holdspan.operators.settle import settled
from holdspan.options import ReadOptions
from holdspan.sources.catalog import ID, SOURCE_ORDER


@dataclass(frozen=True)
class Tables:
    """The recorder's tables: ``meta`` (site_id, metadata_id, series_id, unit), both statistics, ``states``."""

    meta: DataFrame
    statistics: DataFrame
    short_term: DataFrame
    states: DataFrame


@dataclass(frozen=True)
class Loaded:
    """Samples (keys, ``start_ts``, ``end_ts``, ``value``), one provenance row for each series that was
    asked for and measures the quantity, and the series refused because they measure another one."""

    samples: DataFrame
    provenance: DataFrame
    refused: DataFrame


def decide(
    requests: DataFrame, tables: Tables, quantity: str = "power", options: ReadOptions = ReadOptions()
) -> DataFrame:
    """For each requested series (keys): ``source``, ``known``, ``unit``, ``ids`` and ``into`` (scale, offset).

    Rows of all tables are tagged with their table's rank and reduced to the least one, first for each id
    and then for each series: one narrow scan a table. ``into`` is null where the unit is of another
    quantity. A series that no table knows is left to the statistics.
    """
    asked = requests.select(*KEYS).distinct()
    text, rank = F.lit(None).cast("string"), F.lit(None).cast("int")

    def tagged(rows: DataFrame, place: int) -> DataFrame:
        return rows.select(*ID, text.alias("series_id"), text.alias("unit"), F.lit(place).alias("_rank"))

    recorded = tables.meta.select(*ID, "series_id", "unit", rank.alias("_rank"))
    recorded = recorded.unionByName(tagged(tables.statistics, 0)).unionByName(tagged(tables.short_term, 1))
    by_id = recorded.groupBy(*ID).agg(
        F.max("series_id").alias("series_id"), F.max("unit").alias("unit"), F.min("_rank").alias("_rank")
    )
    known = tables.states.select(*KEYS, F.lit(None).cast("bigint").alias("metadata_id"), text.alias("unit"), F.lit(2).alias("_rank"))
    series = by_id.where("series_id is not null").select(*KEYS, F.col("metadata_id").cast("bigint"), "unit", "_rank").unionByName(known)
    facts = series.groupBy(*KEYS).agg(
        F.min("_rank").alias("_rank"), F.max("unit").alias("unit"), F.collect_set("metadata_id").alias("ids")
    )
    chosen = F.element_at(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.coalesce("_rank", F.lit(0)) + 1)
    return asked.join(facts, list(KEYS), "left").select(
        *KEYS,
        (chosen if options.source == "auto" else F.lit(options.source)).alias("source"),
        F.col("_rank").isNotNull().alias("known"),
        "unit",
        "ids",
        conversion(F.col("unit"), quantity, options.scale).alias("into"),
    )


def load_samples(
    requests: DataFrame,
    meta: DataFrame,
    statistics: DataFrame,
    short_term: DataFrame,
    states: DataFrame,
    quantity: str = "power",
    options: ReadOptions = ReadOptions(),
    clamp: bool = False,
    settle: Callable[[DataFrame], DataFrame] = settled,
) -> Loaded:
    """Read each requested series (keys) from the one table that answers for it.

    Units are judged once for each series, before any of its rows is read; a repeated request counts
    once. With a settled decision the samples scan each table once, filtered to the wanted series.
    """
    tables = Tables(meta, statistics, short_term, states)
    decision = settle(decide(requests, tables, quantity, options))
    wanted = decision.filter("into is not null").select(*KEYS, "source", "unit", "ids", "into.scale", "into.offset")
    refused = decision.filter("into is null").select(*KEYS, "source", "unit")
    window = (options.from_ts, options.to_ts)

    def converted(value: Column) -> Column:
        value = value * F.col("scale") + F.col("offset")
        return F.when(value.isNotNull(), clamp_negative(value)) if clamp else value

    def statistic(rows: DataFrame, source: str, table: str) -> DataFrame:
        of = wanted.filter(F.col("source") == source).select(*KEYS, "scale", "offset", F.explode("ids").alias("metadata_id"))
        chosen = rows.join(of, list(ID)).withColumn(options.stat, converted(finite(F.col(options.stat))))
        return statistics_samples(chosen, options.stat, STATISTICS_SECONDS[table], *window)

    of = wanted.filter(F.col("source") == "states").select(*KEYS, "scale", "offset")
    readings = states.join(of, list(KEYS)).select(*KEYS, "ts", "row_id", converted(parse_value(F.col("state"))).alias("value"))
    samples = (
        statistic(statistics, "statistics", "statistics")
        .unionByName(statistic(short_term, "short_term", "statistics_short_term"))
        .unionByName(state_samples(readings, options.max_gap, *window))
    )
    facts = samples.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("samples"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts")
    )
    provenance = wanted.drop("ids").join(facts, list(KEYS), "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return Loaded(samples, provenance, refused)


@dataclass(frozen=True)
class Totals:
    """Readings of running totals in kWh (keys, ``ts``, ``total``), where each meter was read from, and
    the meters whose unit is no energy."""

    readings: DataFrame
    provenance: DataFrame
    refused: DataFrame


def load_totals(
    meters: DataFrame, tables: Tables, settle: Callable[[DataFrame], DataFrame] = settled
) -> Totals:
    """Read each meter (keys) from its hourly statistics, or from raw states where those hold no total.

    The settled decision has a row a meter; each table is then read for the meters it answers for alone.
    Raw states carry no unit and are taken to be in kWh.
    """
    asked = meters.select(*KEYS).distinct()
    ids = tables.meta.join(asked, list(KEYS)).select(*KEYS, F.col("metadata_id").cast("bigint"), "unit")
    hourly = counter_readings(tables.statistics.join(ids, list(ID)), [*KEYS, "unit"])
    found = hourly.groupBy(*KEYS).agg(F.max("unit").alias("unit"), F.lit(True).alias("_hourly"))
    decision = settle(
        asked.join(found, list(KEYS), "left").select(
            *KEYS,
            F.when(F.col("_hourly"), "statistics").otherwise("states").alias("source"),
            "unit",
            F.when(F.col("_hourly"), energy_scale(F.col("unit"))).otherwise(1.0).alias("scale"),
        )
    )
    wanted = decision.filter("scale is not null")

    def of(source: str) -> DataFrame:
        return wanted.filter(F.col("source") == source).select(*KEYS, "scale")

    counted = hourly.drop("unit").join(of("statistics"), list(KEYS)).withColumn("total", F.col("total") * F.col("scale"))
    raw = setting_history(tables.states.join(of("states").select(*KEYS), list(KEYS)))
    readings = counted.select(*KEYS, "ts", "total").unionByName(raw.select(*KEYS, "ts", F.col("value").alias("total")))
    return Totals(readings, wanted, decision.filter("scale is null").select(*KEYS, "source", "unit"))
