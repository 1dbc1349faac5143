"""Readings to intervals, and intervals cut on calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions import calendar as C
from holdspan.functions.values import finite, floor_timestamp, parse_value
from holdspan.operators.chunks import CHUNK, chunk_of, with_previous

# How long a row of each statistics table covers.
STATISTICS_SECONDS = {"statistics": 3_600, "statistics_short_term": 300}


def clip(samples: DataFrame, from_ts: int | None = None, to_ts: int | None = None) -> DataFrame:
    """Intervals cut to ``[from_ts, to_ts)``; empty ones dropped."""
    if from_ts is not None:
        samples = samples.withColumn("start_ts", F.greatest("start_ts", F.lit(from_ts).cast("bigint")))
    if to_ts is not None:
        samples = samples.withColumn("end_ts", F.least("end_ts", F.lit(to_ts).cast("bigint")))
    return samples.filter("end_ts > start_ts")


def statistics_samples(
    rows: DataFrame,
    stat: str = "mean",
    seconds: int = STATISTICS_SECONDS["statistics"],
    from_ts: int | None = None,
    to_ts: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One interval of fixed length per statistics row that has a time and a value.

    The time filter pushed to the scan is one interval wider than the window; the clip is exact.
    """
    if from_ts is not None:
        rows = rows.filter(F.col("start_ts") >= from_ts - seconds)
    if to_ts is not None:
        rows = rows.filter(F.col("start_ts") < to_ts)
    start = floor_timestamp(F.col("start_ts").cast("double"))
    samples = rows.select(
        *keys,
        start.alias("start_ts"),
        (start + seconds).alias("end_ts"),
        finite(F.col(stat)).alias("value"),
    ).filter(F.col("start_ts").isNotNull() & F.col("value").isNotNull())
    return clip(samples, from_ts, to_ts)


def state_samples(
    readings: DataFrame,
    max_gap: int = 900,
    from_ts: int | None = None,
    to_ts: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Each reading held until the next one of its series, at most ``max_gap``.

    ``readings``: keys, ``ts`` (seconds, real or whole), ``row_id``, ``value`` (NULL = unavailable:
    it ends the reading before it and starts nothing).

    Of the readings inside one second only the last can hold for any time, so the others are
    dropped by an aggregate that combines before the shuffle. A reading can only be ended by one
    at most ``max_gap`` later, so a chunk needs, beyond its own rows, just those of that margin:
    they are sent to both chunks and no task ever needs a whole series. Where the margin would be a
    large part of the chunk, every chunk's first reading is handed to the chunk before it instead, and
    a task still holds a day. For the same reason both time filters may go to the scan without
    changing any interval.
    """
    if from_ts is not None:
        readings = readings.filter(F.col("ts") >= from_ts - max_gap)
    if to_ts is not None:
        readings = readings.filter(F.col("ts") < to_ts)
    second = floor_timestamp(F.col("ts").cast("double"))
    latest = (
        readings.select(*keys, second.alias("_at"), F.struct("ts", "row_id", finite(F.col("value")).alias("value")).alias("_row"))
        .filter(F.col("_at").isNotNull())
        .groupBy(*keys, "_at")
        .agg(F.max("_row").getField("value").alias("value"))
    )
    if 4 * max_gap > CHUNK:
        following = with_previous(latest, keys, ["_at"], ["_at"], "_next", backwards=True)
        own_rows = following.withColumn("end_ts", F.least(F.col("_next._at"), F.col("_at") + max_gap))
    else:
        own = chunk_of(F.col("_at"), CHUNK)
        homes = F.when(F.col("_at") - own < max_gap, F.array(own, own - CHUNK)).otherwise(F.array(own))
        placed = latest.withColumn("_chunk", F.explode(homes))
        ordered = Window.partitionBy(*keys, "_chunk").orderBy("_at")
        held = F.least(F.lead("_at").over(ordered), F.col("_at") + max_gap)
        own_rows = placed.withColumn("end_ts", held).filter(chunk_of(F.col("_at"), CHUNK) == F.col("_chunk"))
    samples = own_rows.filter("value is not null").select(*keys, F.col("_at").alias("start_ts"), "end_ts", "value")
    return clip(samples, from_ts, to_ts)


def counter_readings(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A total at the end of each hour: the state, or the mean where there is none."""
    return rows.select(
        *keys,
        (floor_timestamp(F.col("start_ts").cast("double")) + 3_600).alias("ts"),
        finite(F.coalesce("state", "mean")).alias("total"),
    ).filter(F.col("ts").isNotNull() & F.col("total").isNotNull())


def setting_history(states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every numeric state of a setting: ``ts``, ``row_id``, ``value``; other rows dropped."""
    return states.select(
        *keys,
        floor_timestamp(F.col("ts").cast("double")).alias("ts"),
        "row_id",
        parse_value(F.col("state")).alias("value"),
    ).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def changes_only(
    rows: DataFrame,
    value: str = "value",
    order: Sequence[str] = ("ts", "row_id"),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows whose value differs from the row before them in their series; NULL is a value of its own."""
    seen = with_previous(rows, keys, order, [value], "_previous")
    before = F.col(f"_previous.{value}")
    changed = F.col("_previous").isNull() | ~before.eqNullSafe(F.col(value))
    return seen.filter(changed).drop("_previous")


def _pieces(samples: DataFrame, starts: Column, piece_end: Column) -> DataFrame:
    return (
        samples.filter("end_ts > start_ts")
        .withColumn("start_ts", F.explode(starts))
        .withColumn("end_ts", F.least(piece_end, F.col("end_ts")))
        .withColumn("seconds", F.col("end_ts") - F.col("start_ts"))
    )


def hour_slices(samples: DataFrame, tz: str | Column) -> DataFrame:
    """Intervals cut at local hours, with ``seconds``, local ``day`` and ``hour`` of each piece.

    A skipped hour gets nothing, a repeated one both passes, and the seconds add up.
    """
    start = F.col("start_ts")
    local = C.local_seconds(start, tz)
    nxt = start + C.HOUR - F.pmod(local, F.lit(C.HOUR))
    cut = _pieces(samples, C.hour_starts(start, F.col("end_ts"), tz), nxt)
    return cut.withColumns({"day": C.day_of(local), "hour": C.hour_of(local)})


def slot_slices(samples: DataFrame, width: int = 3_600) -> DataFrame:
    """Intervals cut at epoch multiples of ``width``, with ``slot`` and ``seconds``."""
    start = F.col("start_ts")
    cut = _pieces(
        samples,
        C.slot_starts(start, F.col("end_ts"), width),
        C.floor_to(start, width) + width,
    )
    return cut.withColumn("slot", C.floor_to(start, width))


def day_slices(samples: DataFrame, tz: str | Column) -> DataFrame:
    """Intervals cut at local midnights, with local ``day`` and ``seconds``."""
    start, end = F.col("start_ts"), F.col("end_ts")
    days = F.sequence(C.local_day(start, tz), C.local_day(end - 1, tz))
    day = F.col("day")
    return (
        samples.filter("end_ts > start_ts")
        .withColumn("day", F.explode(days))
        .withColumn("start_ts", F.greatest(start, C.midnight(day, tz)))
        .withColumn("end_ts", F.least(end, C.midnight(F.date_add(day, 1), tz)))
        .withColumn("seconds", F.col("end_ts") - F.col("start_ts"))
    )
