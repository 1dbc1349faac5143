"""Ordered operators that never hold one whole series in one task.

A series can be a third of all rows. Each helper therefore cuts series into fixed time chunks, works
inside ``(keys, chunk)``, and passes only one row per chunk through a per-series window: the rows a
single task sees are bounded by the chunk length, and by the calendar across chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan.functions.calendar import DAY, floor_to

CHUNK = DAY


def chunk_of(ts: Column, seconds: int = CHUNK) -> Column:
    """The start of the chunk an instant lies in."""
    return floor_to(ts, seconds)


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: Sequence[str],
    out: str = "previous",
    seconds: int = CHUNK,
    backwards: bool = False,
) -> DataFrame:
    """Each row with the ``state`` struct of the row before it; ``order`` starts with the time.

    ``backwards`` gives the row after it instead.
    """
    way = F.desc if backwards else F.asc
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*[way(c) for c in order])
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.struct(*state)
    marked = rows.withColumn("_chunk", chunk_of(F.col(order[0]), seconds)).withColumns(
        {
            out: F.lag(held).over(inside),
            "_rank": F.row_number().over(inside),
            "_last": F.last(held).over(whole),
        }
    )
    heads = marked.filter("_rank = 1").withColumn(
        out, F.lag("_last").over(Window.partitionBy(*keys).orderBy(way("_chunk")))
    )
    return marked.filter("_rank > 1").unionByName(heads).drop("_chunk", "_rank", "_last")


def last_known(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    out: str,
    seconds: int = CHUNK,
) -> DataFrame:
    """Each row with the last non-NULL ``state`` at or before it in ``order`` (time first)."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here = rows.withColumn("_chunk", chunk_of(F.col(order[0]), seconds))
    # Chunks without a reading take part too, with a NULL end: they still need the carry.
    ends = here.groupBy(*keys, "_chunk").agg(
        F.max(F.when(F.col(state).isNotNull(), F.struct(*order, state))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_chunk", F.last(F.col(f"_end.{state}"), True).over(before).alias("_carry")
    )
    local = here.withColumn(
        "_near", F.last(state, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        local.join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_chunk", "_near", "_carry")
    )


def as_of(
    probes: DataFrame,
    readings: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    probe_ts: str = "ts",
    reading_ts: str = "ts",
    seconds: int = CHUNK,
    strict: bool = False,
) -> DataFrame:
    """Each probe with the last reading's ``value`` at or before its time (before it, if strict).

    ``value`` may be a struct. Probes and readings travel through one shuffle as one stream of
    tagged rows, so no pairs are formed.
    """
    columns = [c for c in probes.columns if c not in keys]
    side = 0 if strict else 1
    asked = probes.select(
        *keys,
        F.col(probe_ts).alias("_at"),
        F.lit(side).alias("_side"),
        F.struct(*columns).alias("_probe"),
        F.lit(None).cast(readings.schema[value].dataType).alias("_value"),
    )
    seen = readings.select(
        *keys,
        F.col(reading_ts).alias("_at"),
        F.lit(1 - side).alias("_side"),
        F.lit(None).cast(asked.schema["_probe"].dataType).alias("_probe"),
        F.col(value).alias("_value"),
    )
    known = last_known(asked.unionByName(seen), keys, ["_at", "_side"], "_value", out, seconds)
    return known.filter(F.col("_side") == side).select(
        *keys, *[F.col(f"_probe.{c}").alias(c) for c in columns], out
    )
