"""The value axis: buckets, thresholds and quantised levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds on the number of levels, and steps on the coverage scale.
MIN_LEVELS, MAX_LEVELS = 3, 16
COVERAGE_LEVELS = 5
# Rounded steps of an axis, as multiples of a power of ten.
NICE_STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)
LABEL_CLEARANCE = 0.08
TICK_SLACK = 1e-9


def bucket_count(max_value: Column, step: float) -> Column:
    """One bucket per step and an open one on top."""
    return F.ceil(max_value / step).cast("bigint") + 1


def raw_bucket(value: Column, step: float) -> Column:
    """Bucket by rounding down, before the open top bucket is applied."""
    usable = ~F.isnan(value) & (value > 0)
    return F.when(usable, F.floor(value / step)).when(value.isNotNull(), F.lit(0)).cast("bigint")


def raw_bucket_up(value: Column, step: float) -> Column:
    """Bucket by rounding up, before the open top bucket is applied."""
    usable = ~F.isnan(value) & (value > 0)
    return F.when(usable, F.ceil(value / step)).when(value.isNotNull(), F.lit(0)).cast("bigint")


def top_clamped(bucket: Column, n_buckets: Column) -> Column:
    """Everything above the axis in its open top bucket."""
    return F.when(bucket.isNotNull(), F.least(bucket, (n_buckets - 1).cast("bigint")))


def bucket_index(value: Column, step: float, n_buckets: Column) -> Column:
    """The bucket a value falls in."""
    return top_clamped(raw_bucket(value, step), n_buckets)


def bucket_at_least(value: Column, step: float, n_buckets: Column) -> Column:
    """The first bucket whose lower edge is at least ``value``."""
    return top_clamped(raw_bucket_up(value, step), n_buckets)


def _levels(levels: int) -> int:
    return max(MIN_LEVELS, min(MAX_LEVELS, levels))


def probability_level(p: Column, levels: int = 10, gamma: float = 0.6, floor: float = 0.005) -> Column:
    """Level 0..levels-1 of a probability, NULL where it is blank."""
    n = _levels(levels)
    gamma = gamma if gamma > 0 else 1.0
    shaped = F.pow(F.least(p, F.lit(1.0)), F.lit(gamma))
    level = F.least(F.floor(shaped * n), F.lit(n - 1)).cast("int")
    return F.when((p > 0) & (p >= floor) & (p < float("inf")), level)


def level_edges(levels: int = 10, gamma: float = 0.6) -> Column:
    """The probability each level starts at, as an array."""
    n = _levels(levels)
    gamma = gamma if gamma > 0 else 1.0
    index = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(index, lambda i: F.pow(i / F.lit(float(n)), F.lit(1.0 / gamma)))


def coverage_level(observed: Column, possible: Column) -> Column:
    """Step 0..4 of observed over possible days, NULL for none observed."""
    share = observed / F.nullif(possible, F.lit(0))
    steps = F.ceil(F.least(share, F.lit(1.0)) * COVERAGE_LEVELS).cast("int")
    bounded = F.least(F.greatest(steps, F.lit(1)), F.lit(COVERAGE_LEVELS)) - 1
    return F.when(observed > 0, F.when(possible == 0, COVERAGE_LEVELS - 1).otherwise(bounded))


def nice_step(top: Column, target: int = 5) -> Column:
    """The 1 / 2 / 2.5 / 5 x 10^n step that cuts ``0..top`` into about ``target`` parts."""
    rough = top / F.lit(float(target))
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(rough)).cast("double"))
    ratio = rough / magnitude
    step = F.lit(NICE_STEPS[-1])
    for size in reversed(NICE_STEPS[:-1]):
        step = F.when(ratio <= size, F.lit(size)).otherwise(step)
    return step * magnitude


def nice_thresholds(bottom: Column, top: Column, target: int = 5) -> Column:
    """The bottom edge, then the round values above it that are not crowded against it."""
    step = nice_step(top, target)
    count = F.floor((top + step * TICK_SLACK) / step).cast("int")
    ticks = F.transform(F.sequence(F.lit(0), count), lambda i: i * step)
    clear = F.filter(
        ticks, lambda t: (t <= top) & (t - bottom > (top - bottom) * LABEL_CLEARANCE)
    )
    return F.concat(F.array(bottom), clear)
