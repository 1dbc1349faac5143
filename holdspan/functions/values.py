"""Values, units and timestamps as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit -> (scale, offset) into the working unit of each quantity.
UNITS = {
    "power": {
        "W": (1.0, 0.0),
        "kW": (1_000.0, 0.0),
        "MW": (1_000_000.0, 0.0),
        "mW": (0.001, 0.0),
    },
    "temperature": {
        "°C": (1.0, 0.0),
        "℃": (1.0, 0.0),
        "°F": (5.0 / 9.0, -32.0 * 5.0 / 9.0),
        "℉": (5.0 / 9.0, -32.0 * 5.0 / 9.0),
        "K": (1.0, -273.15),
    },
}

# What an energy total is multiplied by to be in kWh.
ENERGY_UNITS = {"kWh": 1.0, "": 1.0, "Wh": 0.001, "MWh": 1_000.0}

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
NAIVE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z*$"


def trimmed(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def finite(value: Column) -> Column:
    """The value where it is an ordinary number, else NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def parse_value(text: Column) -> Column:
    """A stored text as a finite double, else NULL; suffixes and words are not numbers."""
    plain = trimmed(text)
    return finite(F.when(plain.rlike(NUMBER), plain.try_cast("double")))


def parse_timestamp(text: Column) -> Column:
    """A stored text as UTC epoch seconds: with a zone, or naive and taken as UTC."""
    plain = trimmed(text)
    naive = F.regexp_replace(F.regexp_replace(plain, "Z+$", ""), "T", " ")
    naive = F.concat(F.regexp_replace(naive, r" ([0-9]{2}:[0-9]{2})$", " $1:00"), F.lit("+00:00"))
    return F.unix_seconds(
        F.when(plain.rlike(ZONED), F.upper(plain).try_cast("timestamp")).when(
            plain.rlike(NAIVE), naive.try_cast("timestamp")
        )
    )


def floor_timestamp(seconds: Column) -> Column:
    """Real epoch seconds rounded down."""
    return F.floor(finite(seconds)).cast("bigint")


def quantity_of(unit: Column) -> Column:
    """Which quantity a unit measures, NULL if it is not a known unit."""
    plain = trimmed(unit)
    out = F.lit(None).cast("string")
    for quantity, units in reversed(UNITS.items()):
        out = F.when(plain.isin(*units), quantity).otherwise(out)
    return out


def conversion(unit: Column, quantity: str, explicit: float | None = None) -> Column:
    """``struct(scale, offset)`` into the working unit, NULL where the unit measures something else."""

    def pair(scale: float, offset: float) -> Column:
        return F.struct(F.lit(scale).alias("scale"), F.lit(offset).alias("offset"))

    if explicit is not None:
        return pair(explicit, 0.0)
    own, measured = trimmed(unit), quantity_of(unit)
    out = F.when(measured.isNotNull() & (measured != quantity), None).otherwise(pair(1.0, 0.0))
    for name, (scale, offset) in UNITS[quantity].items():
        out = F.when(own == name, pair(scale, offset)).otherwise(out)
    return out


def clamp_negative(value: Column) -> Column:
    """Negative readings as zero; values must be finite."""
    return F.greatest(value, F.lit(0.0))


def energy_scale(unit: Column) -> Column:
    """Factor into kWh; NULL for a unit that is not an energy."""
    plain = F.coalesce(trimmed(unit), F.lit(""))
    out = F.lit(None).cast("double")
    for name, scale in ENERGY_UNITS.items():
        out = F.when(plain == name, F.lit(scale)).otherwise(out)
    return out


def convert_units(
    samples: DataFrame, quantity: str, explicit: float | None = None, clamp: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``samples`` with a ``unit`` column, split into converted rows and rows of another quantity."""
    judged = samples.withColumn("_into", conversion(F.col("unit"), quantity, explicit))
    value = F.col("value") * F.col("_into.scale") + F.col("_into.offset")
    converted = judged.filter(F.col("_into").isNotNull()).withColumn(
        "value", clamp_negative(value) if clamp else value
    )
    return converted.drop("_into"), judged.filter(F.col("_into").isNull()).drop("_into")
