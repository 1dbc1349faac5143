"""Reading and analysis parameters, validated when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass

SOURCES = ("auto", "statistics", "short_term", "states")
STATS = ("mean", "min", "max")
GROUPINGS = ("month", "week")
METRICS = ("exceedance", "density")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _positive(name: str, value: float) -> None:
    _require(math.isfinite(value) and value > 0, f"{name} must be a positive number, got {value}")


def _share(name: str, value: float) -> None:
    _require(0.0 <= value <= 1.0, f"{name} must lie between 0 and 1, got {value}")


@dataclass(frozen=True)
class ReadOptions:
    """How a series is read: which table and column, over which time, and in which zone."""

    source: str = "auto"
    stat: str = "mean"
    tz: str = "UTC"
    from_ts: int | None = None
    to_ts: int | None = None
    max_gap: int = 900
    scale: float | None = None
    gap_threshold: int = 86_400

    def __post_init__(self) -> None:
        _require(self.source in SOURCES, f"source must be one of {SOURCES}")
        _require(self.stat in STATS, f"stat must be one of {STATS}")
        _positive("max_gap", self.max_gap)
        _positive("gap_threshold", self.gap_threshold)
        if self.scale is not None:
            _require(math.isfinite(self.scale) and self.scale != 0, "scale must be finite and not zero")
        if self.from_ts is not None and self.to_ts is not None:
            _require(self.from_ts < self.to_ts, "from must come before to")


@dataclass(frozen=True)
class GridOptions:
    """The probability grid: axis, grouping, and what counts as enough evidence."""

    grouping: str = "month"
    metric: str = "exceedance"
    step: float = 50.0
    max_value: float | None = None
    quantile: float = 0.999
    min_days: int = 3
    threshold: float = 100.0
    probability: float = 1.0
    levels: int = 10
    gamma: float = 0.6
    min_probability: float = 0.005

    def __post_init__(self) -> None:
        _require(self.grouping in GROUPINGS, f"grouping must be one of {GROUPINGS}")
        _require(self.metric in METRICS, f"metric must be one of {METRICS}")
        _positive("step", self.step)
        if self.max_value is not None:
            _positive("max_value", self.max_value)
            _require(self.max_value >= self.step, "max_value must be at least one step")
        _share("quantile", self.quantile)
        _share("probability", self.probability)
        _share("min_probability", self.min_probability)
        _positive("min_days", self.min_days)
        _positive("threshold", self.threshold)
        _positive("gamma", self.gamma)
        _require(3 <= self.levels <= 16, "levels must lie between 3 and 16")
        _positive("probability", self.probability)


@dataclass(frozen=True)
class StoreOptions:
    """The bounded store: usable share, round-trip efficiency, optional power limits in kW."""

    usable_fraction: float = 0.9
    round_trip: float = 0.9
    max_charge_kw: float | None = None
    max_discharge_kw: float | None = None

    def __post_init__(self) -> None:
        _share("usable_fraction", self.usable_fraction)
        _share("round_trip", self.round_trip)
        for name in ("max_charge_kw", "max_discharge_kw"):
            if getattr(self, name) is not None:
                _positive(name, getattr(self, name))


@dataclass(frozen=True)
class Economics:
    """Prices: energy bought and sold, and what a store costs."""

    price_per_kwh: float = 0.35
    feed_in_price: float = 0.0
    cost_per_kwh: float = 500.0
    base_cost: float = 1500.0

    def __post_init__(self) -> None:
        for name in ("price_per_kwh", "feed_in_price", "cost_per_kwh", "base_cost"):
            value = getattr(self, name)
            _require(math.isfinite(value) and value >= 0, f"{name} must be a number not below zero, got {value}")


@dataclass(frozen=True)
class HeatingOptions:
    """Degree-day bases and the coverage a day or an hour needs to count."""

    heating_base: float = 15.0
    cooling_base: float = 21.0
    min_coverage: float = 0.9

    def __post_init__(self) -> None:
        _share("min_coverage", self.min_coverage)
        for name in ("heating_base", "cooling_base"):
            value = getattr(self, name)
            _require(-50.0 <= value <= 50.0, f"{name} must lie between -50 and 50, got {value}")
        _require(self.cooling_base >= self.heating_base, "cooling_base must not lie below heating_base")
