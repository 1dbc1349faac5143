"""A bounded running store over ordered steps, for many capacities, and what each one pays back.

One step draws first and fills after, so it maps a level ``s`` to a clamped shift of ``s``. Clamped
shifts are closed under composition (an associative scan: Blelloch, "Prefix sums and their
applications", 1990): a whole block of steps maps ``s`` to ``clamp(s + shift, from_empty, from_full)``,
where the bounds are the levels the block ends at when it starts empty or full. So blocks are
summarised independently, their opening levels follow from the few summaries, and every block is
then replayed on its own. A block holds at most its own slots, whatever the number of raw readings.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdspan.functions.calendar import DAY, floor_to
from holdspan.options import Economics, StoreOptions

SITE = ("site_id",)
BLOCK = 30 * DAY
# Fixed value: seconds in a mean Gregorian year.
YEAR_SECONDS = 365.2425 * DAY


def size_range(low: float, high: float, step: float) -> list[float]:
    """Capacities from ``low`` to ``high``; a parameter list, like an exact one given by hand."""
    if not all(map(math.isfinite, (low, high, step))) or step <= 0 or high < low:
        return []
    count = math.floor((high - low) / step)
    return [low + step * i for i in range(count + 1) if low + step * i > 0]


def exact_sizes(sizes: Iterable[float]) -> list[float]:
    """A hand-given list, checked, sorted, without repeats."""
    out = sorted(set(float(s) for s in sizes))
    if not out or not all(math.isfinite(s) and s > 0 for s in out):
        raise ValueError("sizes must be positive numbers")
    return out


def _replay(steps: pd.DataFrame, level: np.ndarray, usable: np.ndarray, spec: StoreOptions):
    """Run the steps for a vector of stores: end level, drawn, filled, peak."""
    eta = math.sqrt(spec.round_trip)
    hours = steps["seconds"].to_numpy(float) / 3_600.0
    no_limit = np.full(len(steps), np.inf)
    draw_cap = no_limit if spec.max_discharge_kw is None else np.maximum(spec.max_discharge_kw * hours, 0.0)
    fill_cap = no_limit if spec.max_charge_kw is None else np.maximum(spec.max_charge_kw * hours, 0.0)
    demand = np.minimum(steps["import_kwh"].to_numpy(float), draw_cap)
    surplus = np.minimum(steps["export_kwh"].to_numpy(float), fill_cap)
    drawn, filled, peak = np.zeros_like(level), np.zeros_like(level), np.zeros_like(level)
    for need, spare in zip(demand, surplus):
        out = np.maximum(np.minimum(need, level * eta), 0.0)
        level = level - out / eta
        into = np.maximum(np.minimum(spare, (usable - level) / eta), 0.0)
        level = level + into * eta
        drawn += out
        filled += into
        peak = np.maximum(peak, level)
    return level, drawn, filled, peak


def _shift(steps: pd.DataFrame, spec: StoreOptions) -> float:
    """Net level change of the steps if no bound were ever met."""
    eta = math.sqrt(spec.round_trip)
    hours = steps["seconds"].to_numpy(float) / 3_600.0
    draw = steps["import_kwh"].to_numpy(float)
    fill = steps["export_kwh"].to_numpy(float)
    if spec.max_discharge_kw is not None:
        draw = np.minimum(draw, np.maximum(spec.max_discharge_kw * hours, 0.0))
    if spec.max_charge_kw is not None:
        fill = np.minimum(fill, np.maximum(spec.max_charge_kw * hours, 0.0))
    return float((np.maximum(fill, 0.0) * eta - np.maximum(draw, 0.0) / eta).sum())


def _opening_levels(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The level each block starts at, from the block summaries of its key (one per month)."""
    ordered = F.array_sort(F.collect_list(F.struct("_block", "shift", "from_empty", "from_full")))
    folded = blocks.groupBy(*keys, "capacity_kwh").agg(ordered.alias("_blocks"))
    start = F.struct(
        F.lit(0.0).alias("level"), F.array().cast("array<struct<_block:bigint,level:double>>").alias("seen")
    )

    def step(acc: Column, block: Column) -> Column:
        end = F.least(F.greatest(acc["level"] + block["shift"], block["from_empty"]), block["from_full"])
        here = F.struct(block["_block"].alias("_block"), acc["level"].alias("level"))
        return F.struct(end.alias("level"), F.array_append(acc["seen"], here).alias("seen"))

    opened = F.aggregate("_blocks", start, step, lambda acc: acc["seen"])
    return folded.select(*keys, "capacity_kwh", F.explode(opened).alias("_open")).select(
        *keys, "capacity_kwh", "_open._block", F.col("_open.level").alias("opening")
    )


def bounded_store(
    steps: DataFrame,
    sizes: Sequence[float],
    spec: StoreOptions = StoreOptions(),
    keys: Sequence[str] = SITE,
    block: int = BLOCK,
) -> DataFrame:
    """What a store of each capacity would have drawn, filled, lost and cycled, per key.

    ``steps``: keys, start_ts, seconds, import_kwh, export_kwh. The store starts empty; one without
    usable capacity or efficiency does nothing.
    """
    capacity = np.array(list(sizes), dtype=float)
    usable = np.maximum(capacity * spec.usable_fraction, 0.0)
    works = usable > 0 if spec.round_trip > 0 else np.zeros(len(usable), bool)
    key_fields = [steps.schema[k] for k in keys]
    key_names = list(keys)
    double, big = T.DoubleType(), T.LongType()

    def schema(*names: str) -> T.StructType:
        return T.StructType(
            [*key_fields, T.StructField("_block", big), *[T.StructField(n, double) for n in names]]
        )

    def labelled(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for name in [*key_names, "_block"]:
            out[name] = pdf[name].iloc[0]
        return out[[*key_names, "_block", *columns]]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ts", kind="stable")
        size = usable[works]
        both = np.concatenate([np.zeros(len(size)), size])
        low, high = np.split(_replay(pdf, both, np.tile(size, 2), spec)[0], 2)
        return labelled(
            pdf,
            capacity_kwh=capacity[works],
            shift=np.full(len(size), _shift(pdf, spec)),
            from_empty=low,
            from_full=high,
        )

    def replay(pdf: pd.DataFrame, openings: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ts", kind="stable")
        openings = openings.sort_values("capacity_kwh")
        size = np.maximum(openings["capacity_kwh"].to_numpy(float) * spec.usable_fraction, 0.0)
        end, drawn, filled, peak = _replay(pdf, openings["opening"].to_numpy(float), size, spec)
        return labelled(
            pdf,
            capacity_kwh=openings["capacity_kwh"].to_numpy(float),
            drawn=drawn,
            filled=filled,
            peak=peak,
            level=end,
        )

    part = [*keys, "_block"]
    # Few bytes but much arithmetic: an explicit count keeps AQE from merging the blocks into one task.
    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = (
        steps.select(*keys, "start_ts", "seconds", "import_kwh", "export_kwh")
        .withColumn("_block", floor_to(F.col("start_ts"), block))
        .repartition(tasks, *part)
    )
    if works.any():
        blocks = cut.groupBy(*part).applyInPandas(
            summarise, schema("capacity_kwh", "shift", "from_empty", "from_full")
        )
        opened = _opening_levels(blocks, keys)
        played = (
            cut.groupBy(*part)
            .cogroup(opened.repartition(tasks, *part).groupBy(*part))
            .applyInPandas(replay, schema("capacity_kwh", "drawn", "filled", "peak", "level"))
        )
        done = played.groupBy(*keys, "capacity_kwh").agg(
            F.sum("drawn").alias("avoided_import_kwh"),
            F.sum("filled").alias("lost_export_kwh"),
            F.max("peak").alias("peak_kwh"),
            F.max(F.struct("_block", "level")).getField("level").alias("final_kwh"),
        )
    else:
        done = None
    usable_kwh = F.greatest(F.col("capacity_kwh") * spec.usable_fraction, F.lit(0.0))
    names = ["avoided_import_kwh", "lost_export_kwh", "peak_kwh", "final_kwh"]
    if not works.all():
        idle = cut.select(*keys).distinct().withColumn(
            "capacity_kwh", F.explode(F.array(*[F.lit(float(c)) for c in capacity[~works]]))
        )
        idle = idle.select(*keys, "capacity_kwh", *[F.lit(0.0).alias(n) for n in names])
        done = idle if done is None else done.unionByName(idle)
    cycles = F.when((usable_kwh > 0) & F.lit(spec.round_trip > 0), F.col("avoided_import_kwh") / usable_kwh)
    return done.withColumn("full_cycles", F.coalesce(cycles, F.lit(0.0)))


def payback_years(investment: Column, savings: Column) -> Column:
    """Years until an investment is earned back; NULL if it never is."""
    return F.when(savings > 0, investment / savings)


def savings_of(row: dict[str, Column], price: Column, feed_in: float) -> Column:
    """Money saved: energy not bought, less the surplus not sold."""
    return row["avoided_import_kwh"] * price - row["lost_export_kwh"] * F.lit(feed_in)


def price_sizes(
    stores: DataFrame, totals: DataFrame, prices: Economics = Economics(), keys: Sequence[str] = SITE
) -> DataFrame:
    """Stores priced and brought to a year; ``totals`` from the pairing, one row per key."""
    c = F.col
    yearly = F.when(c("seconds") > 0, F.lit(YEAR_SECONDS) / c("seconds")).otherwise(F.lit(0.0))
    observed = savings_of(
        {n: c(n) for n in ("avoided_import_kwh", "lost_export_kwh")},
        F.lit(prices.price_per_kwh),
        prices.feed_in_price,
    )
    reduction = F.when(c("import_kwh") > 0, c("avoided_import_kwh") / c("import_kwh")).otherwise(F.lit(0.0))
    priced = stores.join(totals.select(*keys, "import_kwh", "seconds"), list(keys)).select(
        *stores.columns,
        yearly.alias("annualisation"),
        (F.lit(prices.base_cost) + F.lit(prices.cost_per_kwh) * c("capacity_kwh")).alias("investment"),
        observed.alias("observed_savings"),
        (observed * yearly).alias("annual_savings"),
        reduction.alias("import_reduction"),
        (c("full_cycles") * yearly).alias("cycles_per_year"),
        F.greatest(c("lost_export_kwh") - c("avoided_import_kwh"), F.lit(0.0)).alias("losses_kwh"),
    )
    return priced.withColumn("payback_years", payback_years(c("investment"), c("annual_savings")))


def marginal_payback(priced: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Payback of each step up alone; the first size is measured against none at all."""
    order = Window.partitionBy(*keys).orderBy("capacity_kwh")
    more = F.col("investment") - F.lag("investment", 1, 0.0).over(order)
    gain = F.col("annual_savings") - F.lag("annual_savings", 1, 0.0).over(order)
    return priced.withColumn("marginal_payback_years", payback_years(more, gain))


def best_size(priced: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The fastest payback per key, ties to the smaller size, with the next size up."""
    order = Window.partitionBy(*keys).orderBy("capacity_kwh")
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("payback_years").asc_nulls_last(), "capacity_kwh")
    )
    return (
        priced.withColumn("next_capacity_kwh", F.lead("capacity_kwh").over(order))
        .withColumn("next_payback_years", F.lead("payback_years").over(order))
        .withColumn("_rank", rank)
        .filter("_rank = 1 and payback_years is not null")
        .drop("_rank")
    )


def budget(priced: DataFrame, target_years: float = 5.0, prices: Economics = Economics()) -> DataFrame:
    """What each size would have to cost to pay back in ``target_years``."""
    c = F.col
    affordable = F.when(c("annual_savings") > 0, c("annual_savings") * target_years).otherwise(F.lit(0.0))
    rest = c("budget") - F.lit(prices.base_cost)
    over = (c("investment") > c("budget")) & (c("investment") > 0)
    return (
        priced.withColumn("budget", affordable)
        .withColumn(
            "budget_per_kwh", F.when((c("capacity_kwh") > 0) & (rest > 0), rest / c("capacity_kwh"))
        )
        .withColumn("discount", F.when(over, F.lit(1.0) - c("budget") / c("investment")))
        .withColumn("met", F.coalesce(c("payback_years") <= target_years, F.lit(False)))
    )


def sensitivity_grid(
    best: DataFrame, spread: float = 0.25, prices: Economics = Economics()
) -> DataFrame:
    """Payback of each best size at three prices and three costs; the replay is not repeated."""
    c = F.col
    factors = F.array(F.lit(1.0 - spread), F.lit(1.0), F.lit(1.0 + spread))
    spread_out = best.withColumn("price_factor", F.explode(factors)).withColumn(
        "cost_factor", F.explode(factors)
    )
    price = F.lit(prices.price_per_kwh) * c("price_factor")
    saved = savings_of(
        {n: c(n) for n in ("avoided_import_kwh", "lost_export_kwh")}, price, prices.feed_in_price
    )
    return spread_out.withColumn("price_per_kwh", price).withColumn(
        "payback_years", payback_years(c("investment") * c("cost_factor"), saved * c("annualisation"))
    )


def sizes_meeting_target(budgets: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """How many sizes meet the target, the cheapest that does, and the closest of all."""
    met = F.col("met")
    cheapest = F.min(F.when(met, F.struct("investment", "capacity_kwh")))
    closest = F.min(
        F.when(F.col("payback_years").isNotNull(), F.struct("payback_years", "capacity_kwh"))
    )
    return budgets.groupBy(*keys).agg(
        F.count_if(met).alias("meeting"),
        cheapest.getField("capacity_kwh").alias("cheapest_kwh"),
        closest.getField("capacity_kwh").alias("closest_kwh"),
    )
