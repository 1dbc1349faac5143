"""A sound year's heating energy per square metre, and its class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan.functions import calendar as C

SITE = ("site_id",)
# Efficiency classes by their upper bound in kWh per square metre and year; a figure
# on a bound belongs to the next class.
CLASSES = (
    ("A+", 30.0), ("A", 50.0), ("B", 75.0), ("C", 100.0), ("D", 130.0),
    ("E", 160.0), ("F", 200.0), ("G", 250.0),
)
WORST_CLASS = "H"


def efficiency_class(per_square_metre: Column) -> Column:
    """The class of a figure; NULL stays NULL."""
    out = F.lit(WORST_CLASS)
    for name, below in reversed(CLASSES):
        out = F.when(per_square_metre < below, name).otherwise(out)
    return F.when(per_square_metre.isNotNull(), out)


def sound_years(heating: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Twelve months in a row, all sound: the latest such year, and every July-to-June season."""
    order = Window.partitionBy(*keys).orderBy("month")
    year = order.rowsBetween(-11, 0)
    index = F.year("month") * 12 + F.month("month")
    rows = heating.select(
        *keys,
        F.min("month").over(year).alias("first_month"),
        F.col("month").alias("last_month"),
        F.sum("heating_kwh").over(year).alias("heating_kwh"),
        F.sum("kwh").over(year).alias("kwh"),
        F.count(F.lit(1)).over(year).alias("_months"),
        (F.max(index).over(year) - F.min(index).over(year)).alias("_span"),
        F.min("sound").over(year).alias("_sound"),
    ).filter("_months = 12 and _span = 11 and _sound")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_month"))) == 1
    return (
        rows.withColumn("latest", newest)
        .withColumn("season", F.when(F.month("first_month") == 7, F.year("first_month")))
        .filter(F.col("latest") | F.col("season").isNotNull())
        .select(*keys, "first_month", "last_month", "heating_kwh", "kwh", "season", "latest")
    )


def per_square_metre(
    years: DataFrame, areas: DataFrame, keys: Sequence[str] = SITE
) -> DataFrame:
    """Years over heated and total area, with classes; ``areas``: keys, heated_area, total_area."""
    heated = F.col("heating_kwh") / F.col("heated_area")
    total = F.col("heating_kwh") / F.col("total_area")
    season = C.season_label(F.col("season"))
    return years.join(areas.select(*keys, "heated_area", "total_area"), list(keys)).filter("heated_area is not null").select(
        *years.columns,
        season.alias("label"),
        heated.alias("per_heated"),
        efficiency_class(heated).alias("heated_class"),
        total.alias("per_total"),
        efficiency_class(total).alias("total_class"),
    )
