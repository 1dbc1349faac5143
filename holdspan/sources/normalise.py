"""Recorder tables of either generation as one contract.

The branch on the columns present happens while the plan is built, so what runs is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan.functions.values import parse_timestamp

# Time columns in order of preference, with whether they hold text.
STATISTICS_TIME = (("start_ts", False), ("start", True))
STATES_TIME = (
    ("last_updated_ts", False),
    ("last_updated", True),
    ("last_changed_ts", False),
    ("last_changed", True),
)
STATISTICS_VALUES = ("mean", "min", "max", "state", "sum")


def time_column(df: DataFrame, candidates: tuple[tuple[str, bool], ...]) -> Column:
    """The preferred time column as real epoch seconds."""
    for name, is_text in candidates:
        if name in df.columns:
            stored = df.schema[name].dataType.typeName()
            if is_text and stored == "string":
                return parse_timestamp(F.col(name)).cast("double")
            if stored in ("timestamp", "timestamp_ntz"):
                return F.unix_micros(F.col(name).cast("timestamp")) / 1_000_000
            return F.col(name).cast("double")
    raise ValueError(f"none of the time columns {[n for n, _ in candidates]} is present")


def _site(df: DataFrame) -> Column:
    return F.col("site_id") if "site_id" in df.columns else F.lit(0).cast("bigint").alias("site_id")


def normalise_meta(meta: DataFrame) -> DataFrame:
    """``site_id, metadata_id, series_id, unit`` of the statistics a recorder knows."""
    unit = F.col("unit_of_measurement") if "unit_of_measurement" in meta.columns else F.lit(None)
    return meta.select(
        _site(meta),
        F.col("id").cast("bigint").alias("metadata_id"),
        F.col("statistic_id").alias("series_id"),
        unit.cast("string").alias("unit"),
    )


def normalise_statistics(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Statistics rows named by their series: ``site_id, series_id, unit, start_ts, mean .. sum``."""
    values = [
        (F.col(c) if c in rows.columns else F.lit(None)).cast("double").alias(c)
        for c in STATISTICS_VALUES
    ]
    own = rows.select(
        _site(rows),
        F.col("metadata_id").cast("bigint").alias("metadata_id"),
        time_column(rows, STATISTICS_TIME).alias("start_ts"),
        *values,
    )
    named = own.join(normalise_meta(meta), ["site_id", "metadata_id"])
    return named.select("site_id", "series_id", "unit", "start_ts", *STATISTICS_VALUES)


def normalise_states(states: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """States named by their entity: ``site_id, series_id, row_id, ts, state``."""
    by_id = "metadata_id" in states.columns and meta is not None
    if not by_id and "entity_id" not in states.columns:
        raise ValueError("states carry neither a metadata_id nor an entity_id")
    key = F.col("metadata_id").cast("bigint") if by_id else F.col("entity_id").alias("series_id")
    rows = states.select(
        _site(states),
        key,
        F.col("state_id").cast("bigint").alias("row_id"),
        time_column(states, STATES_TIME).alias("ts"),
        F.col("state").cast("string").alias("state"),
    )
    if by_id:
        names = meta.select(
            _site(meta), F.col("metadata_id").cast("bigint"), F.col("entity_id").alias("series_id")
        )
        rows = rows.join(names, ["site_id", "metadata_id"])
    return rows.select("site_id", "series_id", "row_id", "ts", "state")
