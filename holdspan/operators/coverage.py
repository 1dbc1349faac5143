"""What part of the calendar a history covers, and where its holes are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions import calendar as C
from holdspan.operators.chunks import CHUNK, chunk_of

# What makes a year, and when a history needs caution.
YEAR_DAYS = 365
SPARSE_DAYS = 30
SPARSE_SHARE = 0.15
FULL_DAY_SECONDS = 20 * 3_600


def outages(samples: DataFrame, threshold: int = 86_400, keys: Sequence[str] = KEYS) -> DataFrame:
    """Holes of at least ``threshold`` seconds inside a series, overlaps merged first.

    A hole opens where an interval starts after everything before it has ended. Inside a day chunk that
    end is a window over its rows; of earlier chunks one row each, their latest end, is carried on. So
    a task holds a day of a series, or its calendar, whatever the threshold.
    """
    least = max(int(threshold), 1)
    real = samples.filter("end_ts > start_ts").select(*keys, "start_ts", "end_ts")
    chunked = real.withColumn("_chunk", chunk_of(F.col("start_ts"), CHUNK))
    ahead = (Window.unboundedPreceding, -1)
    ends = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max("end_ts").alias("_end"))
        .select(
            *keys,
            "_chunk",
            F.max("_end").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*ahead)).alias("_carried"),
        )
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("start_ts", "end_ts").rowsBetween(*ahead)
    seconds = F.col("start_ts") - F.col("_until")
    return (
        chunked.withColumn("_before", F.max("end_ts").over(inside))
        .join(ends, [*keys, "_chunk"])
        .withColumn("_until", F.greatest("_before", "_carried"))
        .filter(seconds >= least)
        .select(
            *keys,
            F.col("_until").alias("start_ts"),
            F.col("start_ts").alias("end_ts"),
            seconds.alias("seconds"),
        )
    )


def spans(samples: DataFrame, tz: str | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last instant, their local days (the last instant is exclusive), and total time."""
    real = samples.filter("end_ts > start_ts")
    last = F.greatest(F.col("last_ts") - 1, F.col("first_ts"))
    return (
        real.groupBy(*keys)
        .agg(
            F.min("start_ts").alias("first_ts"),
            F.max("end_ts").alias("last_ts"),
            F.sum(F.col("end_ts") - F.col("start_ts")).alias("observed_seconds"),
        )
        .withColumns(
            {"first_day": C.local_day(F.col("first_ts"), tz), "last_day": C.local_day(last, tz)}
        )
    )


def calendar_spine(span: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every local day from ``first_day`` to ``last_day``."""
    return span.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day"))


def possible_days(span: DataFrame, grouping: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar days each facet could have had inside the span."""
    return (
        calendar_spine(span, keys)
        .groupBy(*keys, C.facet_of(F.col("day"), grouping).alias("facet"))
        .agg(F.count(F.lit(1)).alias("possible_days"))
    )


def missing_facets(
    span: DataFrame, present: DataFrame, grouping: str = "month", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Facets without data that the span could have reached; all of them once it is a year long."""
    facets = F.explode(F.sequence(F.lit(1), F.lit(C.facet_count(grouping))))
    year = F.date_diff("last_day", "first_day") >= YEAR_DAYS
    every = span.filter(year).select(*keys, facets.alias("facet"))
    some = possible_days(span.filter(~year), grouping, keys).select(*keys, "facet")
    return (
        every.unionByName(some)
        .join(present.select(*keys, "facet").distinct(), [*keys, "facet"], "left_anti")
        .withColumn("label", C.facet_short_label(F.col("facet"), grouping))
    )


def coverage_summary(
    span: DataFrame,
    days: DataFrame,
    holes: DataFrame,
    missing: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per series: span, observed and full days, outages and missing facets.

    ``days``: keys, observed_days, full_days. ``holes``: from :func:`outages`.
    """
    lost = holes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outages"),
        F.sum("seconds").alias("missing_seconds"),
        F.max(F.struct("seconds", "start_ts")).alias("_longest"),
    )
    absent = missing.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("facet", "label"))), lambda f: f["label"]).alias("missing_facets")
    )
    return (
        span.join(days, list(keys), "left")
        .join(lost, list(keys), "left")
        .join(absent, list(keys), "left")
        .select(
            *keys,
            "first_ts",
            "last_ts",
            "first_day",
            "last_day",
            F.greatest(F.date_diff("last_day", "first_day") + 1, F.lit(1)).alias("span_days"),
            F.coalesce("observed_days", F.lit(0)).alias("observed_days"),
            F.coalesce("full_days", F.lit(0)).alias("full_days"),
            "observed_seconds",
            F.coalesce("outages", F.lit(0)).alias("outages"),
            F.coalesce("missing_seconds", F.lit(0)).alias("missing_seconds"),
            F.col("_longest.seconds").alias("longest_outage"),
            F.coalesce("missing_facets", F.array().cast("array<string>")).alias("missing_facets"),
        )
    )


def coverage_flags(summary: DataFrame) -> DataFrame:
    """Shares and warnings derived from :func:`coverage_summary`."""
    lost = F.least(
        F.col("missing_seconds") / (F.col("span_days") * F.lit(float(C.DAY))), F.lit(1.0)
    )
    return (
        summary.withColumn("day_fraction", F.col("observed_days") / F.col("span_days"))
        .withColumn("missing_fraction", lost)
        .withColumn("full_year", F.col("span_days") >= YEAR_DAYS)
        .withColumn(
            "sparse",
            (F.col("observed_days") < SPARSE_DAYS) | (F.col("missing_fraction") > SPARSE_SHARE),
        )
        .withColumn("caution", ~F.col("full_year") | F.col("sparse"))
    )


def _day_calendar(days: DataFrame, covered: str, keys: Sequence[str]) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed_days"),
        F.count_if(F.col(covered) >= FULL_DAY_SECONDS).alias("full_days"),
        F.array_sort(F.collect_set(F.month("day"))).alias("months"),
    )


def paired_calendar(
    steps: DataFrame, tz: str | Column, keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """Observed days, days with 20 paired hours, and months present; a step counts where it starts."""
    days = (
        steps.withColumn("day", C.local_day(F.col("start_ts"), tz))
        .groupBy(*keys, "day")
        .agg(F.sum("seconds").alias("seconds"))
    )
    return _day_calendar(days, "seconds", keys)


def thermometer_days(day_means: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from day means, by covered time."""
    return _day_calendar(day_means, "covered_seconds", keys)
