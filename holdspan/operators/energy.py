"""Power integrated into slots, and two directions paired slot by slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.operators.intervals import slot_slices

JOULES_PER_KWH = 3_600_000.0


def slot_energy(samples: DataFrame, width: int = 3_600, keys: Sequence[str] = KEYS) -> DataFrame:
    """kWh and observed seconds per series and slot."""
    value = F.col("value")
    usable = samples.filter(~F.isnan(value) & (F.abs(value) < float("inf")))
    return (
        slot_slices(usable, width)
        .groupBy(*keys, "slot")
        .agg(
            (F.sum(value * F.col("seconds")) / JOULES_PER_KWH).alias("kwh"),
            F.sum("seconds").alias("seconds"),
        )
    )


def common_span(samples: DataFrame, width: int = 3_600, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The slots that cover every series of a site: first slot and how many."""
    first, last = F.min("start_ts"), F.max("end_ts")
    origin = first - F.pmod(first, F.lit(width))
    return (
        samples.filter("end_ts > start_ts")
        .groupBy(*keys)
        .agg(
            origin.alias("origin_ts"),
            F.greatest(F.ceil((last - origin) / width), F.lit(1)).cast("bigint").alias("slots"),
        )
    )


def role_slots(samples: DataFrame, width: int = 3_600, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Import and export of a site side by side, from one scan of samples with a ``role``.

    Slots are epoch-aligned, so both directions meet in one aggregation and no join is needed.
    """
    out = slot_energy(samples, width, [*keys, "role"])

    def of(role: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col(column))), F.lit(0))

    return out.groupBy(*keys, "slot").agg(
        of("import", "kwh").cast("double").alias("import_kwh"),
        of("export", "kwh").cast("double").alias("export_kwh"),
        of("import", "seconds").alias("import_seconds"),
        of("export", "seconds").alias("export_seconds"),
    )


def join_slots(imports: DataFrame, exports: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The same from two slot tables, one per direction: a full outer join on the slot."""

    def side(slots: DataFrame, role: str) -> DataFrame:
        return slots.select(
            *keys, "slot", F.col("kwh").alias(f"{role}_kwh"), F.col("seconds").alias(f"{role}_seconds")
        )

    joined = side(imports, "import").join(side(exports, "export"), [*keys, "slot"], "full_outer")
    return joined.fillna(0, ["import_kwh", "export_kwh", "import_seconds", "export_seconds"])


def paired_slots(both: DataFrame, width: int = 3_600, min_coverage: float = 0.9) -> DataFrame:
    """Slots with a ``fate``: kept, dropped_partial (both seen, too thin) or dropped_unpaired."""
    needed = width * min(max(min_coverage, 0.0), 1.0)
    imported, exported = F.col("import_seconds"), F.col("export_seconds")
    fate = (
        F.when((imported >= needed) & (exported >= needed), "kept")
        .when((imported > 0) & (exported > 0), "dropped_partial")
        .otherwise("dropped_unpaired")
    )
    return (
        both.filter((imported > 0) | (exported > 0))
        .withColumn("fate", fate)
        .withColumn("start_ts", F.col("slot"))
        .withColumn("seconds", F.least(imported, exported))
    )


def kept_steps(paired: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The steps of the common history."""
    return paired.filter("fate = 'kept'").select(*keys, "start_ts", "seconds", "import_kwh", "export_kwh")


def pairing_totals(paired: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Energy and time kept, and slots dropped for either reason. Without a kept slot the sums are null."""
    kept = F.col("fate") == "kept"

    def total(column: str) -> Column:
        return F.sum(F.when(kept, F.col(column)))

    return paired.groupBy(*keys).agg(
        F.count_if(kept).alias("steps"),
        total("import_kwh").cast("double").alias("import_kwh"),
        total("export_kwh").cast("double").alias("export_kwh"),
        total("seconds").alias("seconds"),
        F.count_if(F.col("fate") == "dropped_partial").alias("dropped_partial"),
        F.count_if(F.col("fate") == "dropped_unpaired").alias("dropped_unpaired"),
    )


def steps_as_samples(steps: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Kept steps as intervals of mean power both ways, so that coverage applies to them."""
    seconds = F.greatest(F.col("seconds"), F.lit(1)).cast("bigint")
    return steps.select(
        *keys,
        "start_ts",
        (F.col("start_ts") + seconds).alias("end_ts"),
        ((F.col("import_kwh") + F.col("export_kwh")) * JOULES_PER_KWH / seconds).alias("value"),
    )
