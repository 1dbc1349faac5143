"""Exceedance probabilities: how long each hour of day spent in each value bucket.

Everything here starts from one additive cube, seconds per ``(series, day, hour, bucket)``. A day is
inside one month, one ISO week and one half-year, so any grouping of days is a second, small
aggregation of the cube, and distinct days are plain row counts after a group by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions import buckets as B
from holdspan.functions import calendar as C
from holdspan.functions.values import finite
from holdspan.operators.intervals import hour_slices

# Hours that make a full day, and slack on a probability target.
FULL_DAY_HOURS = 20
PROBABILITY_SLACK = 1e-9
HOURS = tuple(range(24))


def _usable(samples: DataFrame) -> DataFrame:
    """Intervals of some length with a finite value; one bad reading must not set an axis."""
    return samples.filter((F.col("end_ts") > F.col("start_ts")) & finite(F.col("value")).isNotNull())


def exposure_cube(
    samples: DataFrame, tz: str | Column, step: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Seconds and pieces per series, local day, hour and bucket, before any top is applied.

    ``on_edge`` are the seconds that rounding up leaves in the same bucket: values on its lower edge, and
    those that are not positive. With them the axis comes from the cube as well.
    """
    value = F.col("value")
    usable = _usable(samples)
    low = B.raw_bucket(value, step)
    return (
        hour_slices(usable, tz)
        .select(
            *keys,
            "day",
            "hour",
            low.alias("low"),
            "seconds",
            F.when(B.raw_bucket_up(value, step) == low, F.col("seconds")).otherwise(F.lit(0)).alias("on_edge"),
        )
        .groupBy(*keys, "day", "hour", "low")
        .agg(
            F.sum("seconds").alias("seconds"),
            F.count(F.lit(1)).alias("slices"),
            F.sum("on_edge").alias("on_edge"),
        )
    )


def axis_max(
    samples: DataFrame, step: float, quantile: float = 0.999, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Top of the axis per series: the time-weighted quantile of positive readings, rounded up.

    The answer is a whole step, so ordering whole steps is exact: samples are summed per step where
    they lie, and only one row per step goes through the window.
    """
    share = min(max(quantile, 0.0), 1.0)
    usable = _usable(samples)
    held = F.when(F.col("high") > 0, F.col("end_ts") - F.col("start_ts")).otherwise(F.lit(0))
    weights = (
        usable.withColumn("high", B.raw_bucket_up(F.col("value"), step))
        .groupBy(*keys, "high")
        .agg(F.sum(held).alias("weight"))
    )
    return _quantile_axis(weights, step, share, keys)


def axis_from_cube(cube: DataFrame, step: float, quantile: float = 0.999, keys: Sequence[str] = KEYS) -> DataFrame:
    """The axis of ``axis_max`` from the cube alone, without a second pass over the samples.

    Seconds per bucket are a mergeable histogram: days and hours are summed up, and each bucket is told
    apart by the edge that its values are rounded up to.
    """
    share = min(max(quantile, 0.0), 1.0)
    held = cube.groupBy(*keys, "low").agg(F.sum("seconds").alias("seconds"), F.sum("on_edge").alias("on_edge"))
    ends = F.array(
        F.struct(F.col("low").alias("high"), F.when(F.col("low") > 0, F.col("on_edge")).otherwise(F.lit(0)).alias("weight")),
        F.struct((F.col("low") + 1).alias("high"), (F.col("seconds") - F.col("on_edge")).alias("weight")),
    )
    seen = held.select(*keys, F.explode(ends).alias("end")).select(*keys, "end.high", "end.weight")
    weights = seen.groupBy(*keys, "high").agg(F.sum("weight").alias("weight"))
    return _quantile_axis(weights, step, share, keys)


def _quantile_axis(weights: DataFrame, step: float, share: float, keys: Sequence[str]) -> DataFrame:
    """The first whole step ``high`` that ``share`` of all weight does not exceed, at least one step."""
    over = Window.partitionBy(*keys)
    running = F.sum("weight").over(over.orderBy("high"))
    total = F.sum("weight").over(over)
    reached = weights.select(
        *keys,
        F.when((F.col("high") > 0) & (F.col("weight") > 0) & (running >= total.cast("double") * share), F.col("high")).alias("cut"),
    )
    axis = reached.groupBy(*keys).agg(F.coalesce(F.min("cut"), F.lit(1)).alias("steps"))
    top = F.col("steps") * F.lit(step)
    return axis.select(*keys, top.alias("max_value"), B.bucket_count(top, step).alias("n_buckets"))


def fixed_axis(
    samples: DataFrame, step: float, max_value: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The same axis for every series."""
    top = F.lit(float(max_value))
    return (
        samples.select(*keys)
        .distinct()
        .select(*keys, top.alias("max_value"), B.bucket_count(top, step).alias("n_buckets"))
    )


def with_grouping(cube: DataFrame, grouping: str) -> DataFrame:
    """The cube with a ``facet`` column: month, ISO week, or half-year."""
    facet = C.half_year(F.month("day")) if grouping == "half_year" else C.facet_of(F.col("day"), grouping)
    return cube.withColumn("facet", facet)


def exposure_grid(
    cube: DataFrame, axis: DataFrame, by: Sequence[str] = ("facet",), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Seconds and pieces per group, hour and bucket, values above the axis in its top bucket."""
    return (
        cube.groupBy(*keys, *by, "hour", "low")
        .agg(F.sum("seconds").alias("seconds"), F.sum("slices").alias("slices"))
        .join(axis, list(keys))
        .groupBy(*keys, *by, "hour", B.top_clamped(F.col("low"), F.col("n_buckets")).alias("bucket"))
        .agg(
            F.sum("seconds").alias("seconds"),
            F.sum("slices").alias("slices"),
            F.first("n_buckets").alias("n_buckets"),
        )
    )


def evidence_days(cube: DataFrame, grouping: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct local days per column, per facet and over all; unions, never sums of columns."""
    seen = with_grouping(cube.select(*keys, "day", "hour").distinct(), grouping)
    days = seen.select(*keys, "facet", "day").distinct()
    none = F.lit(None).cast("int")
    count = F.count(F.lit(1)).alias("days")
    column = seen.groupBy(*keys, "facet", "hour").agg(count)
    facet = days.groupBy(*keys, "facet").agg(count).withColumn("hour", none)
    whole = days.groupBy(*keys).agg(count).withColumns({"facet": none, "hour": none})
    return column.unionByName(facet).unionByName(whole)


def full_days(
    cube: DataFrame, hours: int = FULL_DAY_HOURS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Observed days and those seen in at least ``hours`` hour columns."""
    return (
        cube.select(*keys, "day", "hour")
        .distinct()
        .groupBy(*keys, "day")
        .agg(F.count(F.lit(1)).alias("hours"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("observed_days"),
            F.count_if(F.col("hours") >= max(hours, 1)).alias("full_days"),
        )
    )


def exceedance_steps(
    grid: DataFrame, by: Sequence[str] = ("facet",), step: float = 50.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The exceedance of every seen column as a step function of the bucket: a row for each bucket with time.

    ``P(value >= edge)`` is the same from the bucket above the last one with time (``first_bucket``) up to
    the row's own (``last_bucket``), which alone has ``density``; a last row says that nothing lies above
    the top one. So rows follow what was measured, however long the axis.
    """
    column = Window.partitionBy(*keys, *by, "hour")
    upward = column.orderBy("bucket")
    total = F.sum("seconds").over(column)
    known = grid.filter("seconds > 0").select(
        *keys,
        *by,
        "hour",
        "n_buckets",
        (F.coalesce(F.lag("bucket").over(upward), F.lit(-1)) + 1).alias("first"),
        F.col("bucket").alias("last"),
        (F.sum("seconds").over(column.orderBy(F.col("bucket").desc())) / total).alias("exceedance"),
        (F.col("seconds") / total).alias("density"),
        F.lead("bucket").over(upward).isNull().alias("is_top"),
    )
    top = F.col("n_buckets") - 1
    own = F.struct(F.col("first"), F.col("last"), F.col("exceedance"), F.col("density"))
    above = F.struct(
        (F.col("last") + 1).alias("first"), top.alias("last"), F.lit(0.0).alias("exceedance"), F.lit(0.0).alias("density")
    )
    ranges = F.when(F.col("is_top") & (F.col("last") < top), F.array(own, above)).otherwise(F.array(own))
    return known.select(*keys, *by, "hour", "n_buckets", F.explode(ranges).alias("r")).select(
        *keys,
        *by,
        "hour",
        F.col("r.first").cast("bigint").alias("first_bucket"),
        F.col("r.last").cast("bigint").alias("last_bucket"),
        (F.col("r.first") * F.lit(step)).alias("first_edge"),
        "r.exceedance",
        "r.density",
        "n_buckets",
    )


def exceedance(grid: DataFrame, by: Sequence[str] = ("facet",), step: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``P(value >= edge)`` and the share inside each bucket, for every bucket of a seen column.

    The step function written out: as many rows as the axis has buckets. For axes of unknown length keep
    to :func:`exceedance_steps` and ask with :func:`probability_at`.
    """
    bucket = F.col("bucket")
    steps = exceedance_steps(grid, by, step, keys)
    return steps.withColumn("bucket", F.explode(F.sequence("first_bucket", "last_bucket"))).select(
        *keys,
        *by,
        "hour",
        "bucket",
        (bucket * F.lit(step)).alias("edge"),
        "exceedance",
        F.when(bucket == F.col("last_bucket"), F.col("density")).otherwise(F.lit(0.0)).alias("density"),
        "n_buckets",
    )


def _cell(metric: str, bucket: Column) -> Column:
    """A step function's value at a bucket of its row."""
    if metric == "exceedance":
        return F.col("exceedance")
    return F.when(bucket == F.col("last_bucket"), F.col("density")).otherwise(F.lit(0.0))


def _looked_up(steps: DataFrame, asked: Column, metric: str) -> DataFrame:
    """``steps`` with a row for each of ``asked`` (threshold, bucket) that falls into them, as ``threshold`` and ``cell``."""
    inside = F.filter(asked, lambda m: m["bucket"].between(F.col("first_bucket"), F.col("last_bucket")))
    found = steps.withColumn("_mark", F.explode(inside))
    return found.withColumns({"threshold": F.col("_mark.threshold"), "cell": _cell(metric, F.col("_mark.bucket"))}).drop("_mark")


def probability_at(
    steps: DataFrame,
    thresholds: Sequence[float],
    step: float,
    metric: str = "exceedance",
    by: Sequence[str] = ("facet",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The probability of reaching each threshold, rounded up to an edge or down to the top one; an as-of look-up."""
    marks = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), B.bucket_at_least(F.lit(float(t)), step, F.col("n_buckets")).alias("bucket")
            )
            for t in thresholds
        ]
    )
    return _looked_up(steps, marks, metric).select(*keys, *by, "hour", "threshold", F.col("cell").alias(metric))


def column_status(seconds: Column, days: Column, min_days: int = 3) -> Column:
    """``empty`` without time, ``thin`` below ``min_days`` distinct days, else ``sufficient``."""
    nothing = seconds.isNull() | (seconds <= 0) | (days == 0)
    return F.when(nothing, "empty").when(days < min_days, "thin").otherwise("sufficient")


def columns_seen(
    cube: DataFrame, by: Sequence[str] = ("facet",), min_days: int = 3, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Seconds, pieces, distinct days and status of every hour column that has data."""
    return (
        cube.groupBy(*keys, *by, "hour", "day")
        .agg(F.sum("seconds").alias("seconds"), F.sum("slices").alias("slices"))
        .groupBy(*keys, *by, "hour")
        .agg(
            F.sum("seconds").alias("seconds"),
            F.sum("slices").alias("slices"),
            F.count(F.lit(1)).alias("days"),
        )
        .withColumn("status", column_status(F.col("seconds"), F.col("days"), min_days))
    )


def all_hours(seen: DataFrame, by: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """All 24 hours of every group that has data, the missing ones as empty columns.

    A group has at most 24 columns, so it is folded to one row, filled, and unfolded again.
    """
    facts = ["seconds", "slices", "days"]
    folded = seen.groupBy(*keys, *by).agg(
        F.map_from_entries(
            F.collect_list(F.struct("hour", F.struct(*facts, "status").alias("facts")))
        ).alias("_columns")
    )
    spread = folded.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in HOURS])))
    fact = F.element_at("_columns", F.col("hour"))
    return spread.select(
        *keys,
        *by,
        "hour",
        *[F.coalesce(fact.getField(f), F.lit(0)).cast("bigint").alias(f) for f in facts],
        F.coalesce(fact.getField("status"), F.lit("empty")).alias("status"),
    )


def facet_columns(
    cube: DataFrame,
    possible: DataFrame,
    grouping: str = "month",
    min_days: int = 3,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """24 columns per facet with data, beside the days the calendar could have given."""
    seen = columns_seen(with_grouping(cube, grouping), ("facet",), min_days, keys)
    return (
        all_hours(seen, ("facet",), keys)
        .join(possible, [*keys, "facet"], "left")
        .withColumn("possible_days", F.coalesce("possible_days", F.lit(0)).cast("bigint"))
    )


def pooled_columns(cube: DataFrame, min_days: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """24 columns over the whole record: pooled seconds and united days, never averaged shares."""
    return all_hours(columns_seen(cube, (), min_days, keys), (), keys)


def season_columns(cube: DataFrame, min_days: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """24 columns per half-year; from days, so the same under any grouping."""
    seen = columns_seen(with_grouping(cube, "half_year"), ("facet",), min_days, keys)
    return all_hours(seen, ("facet",), keys).withColumnRenamed("facet", "half_year")


def reliable_window(
    cube: DataFrame,
    axis: DataFrame,
    step: float,
    threshold: float = 100.0,
    probability: float = 1.0,
    min_days: int = 3,
    by: Sequence[str] = ("facet",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """First and last hour that reach ``threshold`` with ``probability``, on sufficient columns.

    The threshold is rounded up to a bucket edge, or down to the top edge when it lies above the
    axis; the edge answered for is part of the result.
    """
    wanted = B.bucket_at_least(F.lit(float(threshold)), step, F.col("n_buckets"))
    # The wanted bucket is never above the top one, so raw buckets compare the same as clamped ones.
    hit = F.when(F.col("low") >= wanted, F.col("seconds")).otherwise(F.lit(0))
    columns = (
        cube.join(axis, list(keys))
        .groupBy(*keys, *by, "n_buckets", "hour", "day")
        .agg(F.sum("seconds").alias("seconds"), F.sum(hit).alias("hit"))
        .groupBy(*keys, *by, "n_buckets", "hour")
        .agg(
            F.sum("seconds").alias("seconds"),
            F.sum("hit").alias("hit"),
            F.count(F.lit(1)).alias("days"),
        )
    )
    good = (column_status(F.col("seconds"), F.col("days"), min_days) == "sufficient") & (
        F.col("hit") / F.col("seconds") >= probability - PROBABILITY_SLACK
    )
    hour = F.when(good, F.col("hour"))
    spans = columns.groupBy(*keys, *by, "n_buckets").agg(
        F.min(hour).alias("earliest"), F.max(hour).alias("latest"), F.count(hour).alias("hours")
    )
    return spans.select(
        *keys,
        *by,
        (wanted * F.lit(step)).alias("threshold"),
        "earliest",
        "latest",
        "hours",
        F.coalesce(F.col("hours") == F.col("latest") - F.col("earliest") + 1, F.lit(True)).alias("contiguous"),
    )


def facets_never_reaching(windows: DataFrame) -> DataFrame:
    """Facets whose reliable window is empty."""
    return windows.filter(F.col("earliest").isNull())


def probability_table(
    steps: DataFrame,
    columns: DataFrame,
    axis: DataFrame,
    step: float,
    metric: str = "exceedance",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rounded thresholds by 24 hours per facet, NULL for insufficient columns, and a row of days.

    ``steps`` (:func:`exceedance_steps`) and ``columns`` are per facet; the days row has a NULL threshold.
    A series has a handful of thresholds, which travel to its steps as one array.
    """
    n = F.col("n_buckets")
    first = F.least(F.lit(1), n - 1) if metric == "exceedance" else F.lit(0)
    marks = B.nice_thresholds((first * F.lit(step)).cast("double"), ((n - 1) * F.lit(step)).cast("double"))
    asked = F.transform(marks, lambda t: F.struct(t.alias("threshold"), B.bucket_index(t, step, n).alias("bucket")))
    wanted = axis.select(*keys, asked.alias("_asked"))
    shown = columns.filter("status = 'sufficient'").select(*keys, "facet", "hour")
    cells = (
        _looked_up(steps.join(wanted, list(keys)), F.col("_asked"), metric)
        .select(*keys, "facet", "hour", "threshold", "cell")
        .join(shown.withColumn("shown", F.lit(True)), [*keys, "facet", "hour"], "left")
        .select(*keys, "facet", "threshold", "hour", F.when(F.col("shown"), F.col("cell")).alias("cell"))
    )
    days = columns.select(
        *keys,
        "facet",
        F.lit(None).cast("double").alias("threshold"),
        "hour",
        F.col("days").cast("double").alias("cell"),
    )
    wide = cells.unionByName(days).groupBy(*keys, "facet", "threshold").pivot("hour", list(HOURS))
    return wide.agg(F.first("cell")).withColumnsRenamed({str(h): f"h{h:02d}" for h in HOURS})


def level_runs(
    steps: DataFrame,
    metric: str = "exceedance",
    levels: int = 10,
    gamma: float = 0.6,
    min_probability: float = 0.005,
    by: Sequence[str] = ("facet",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Maximal runs of neighbouring buckets with one level, column by column; blanks break runs.

    A row of ``steps`` (:func:`exceedance_steps`) has one level, and runs are joined from rows.
    """
    n = F.col("n_buckets")
    least = F.least(F.lit(1), n - 1) if metric == "exceedance" else F.lit(0)
    first = F.col("first_bucket") if metric == "exceedance" else F.col("last_bucket")
    level = B.probability_level(F.col(metric), levels, gamma, min_probability)
    column = [*keys, *by, "hour"]
    inked = (
        steps.select(*column, F.greatest(first, least).alias("first_bucket"), "last_bucket", level.alias("level"))
        .filter("level is not null and first_bucket <= last_bucket")
    )
    upward = Window.partitionBy(*column).orderBy("first_bucket")
    before = (F.lag("level").over(upward) == F.col("level")) & (F.lag("last_bucket").over(upward) + 1 == F.col("first_bucket"))
    started = inked.withColumn("_new", F.when(before, F.lit(0)).otherwise(F.lit(1)))
    return (
        started.withColumn("_run", F.sum("_new").over(upward))
        .groupBy(*column, "level", "_run")
        .agg(F.min("first_bucket").alias("first_bucket"), F.max("last_bucket").alias("last_bucket"))
        .drop("_run")
    )
