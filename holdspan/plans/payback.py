"""The payback report: two directions of power to the capacity worth buying."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from holdspan import KEYS
from holdspan.options import Economics, ReadOptions, StoreOptions
from holdspan.operators import coverage, energy, store
from holdspan.operators.settle import settled
from holdspan.sources.load import Tables, load_samples


def payback_report(
    samples: DataFrame,
    sizes: Sequence[float],
    tz: str | Column = "UTC",
    width: int = 3_600,
    min_coverage: float = 0.9,
    spec: StoreOptions = StoreOptions(),
    prices: Economics = Economics(),
    target_years: float = 5.0,
    spread: float = 0.25,
    keys: Sequence[str] = ("site_id",),
) -> dict[str, DataFrame]:
    """Every table of the report from samples with a ``role`` of import or export."""
    paired = energy.paired_slots(energy.role_slots(samples, width, keys), width, min_coverage)
    steps = energy.kept_steps(paired, keys)
    totals = energy.pairing_totals(paired, keys)
    stores = store.bounded_store(steps, sizes, spec, keys)
    priced = store.marginal_payback(store.price_sizes(stores, totals, prices, keys), keys)
    best = store.best_size(priced, keys)
    budgets = store.budget(priced, target_years, prices)
    return {
        "totals": totals,
        "sizes": priced,
        "best": best,
        "budgets": budgets,
        "meeting": store.sizes_meeting_target(budgets, keys),
        "sensitivity": store.sensitivity_grid(best, spread, prices),
        "calendar": coverage.paired_calendar(steps, tz, keys),
        "outages": coverage.outages(energy.steps_as_samples(steps, keys), 86_400, keys),
    }


def recorded_payback(
    roles: DataFrame,
    tables: Tables,
    sizes: Sequence[float],
    read: ReadOptions = ReadOptions(),
    settle: Callable[[DataFrame], DataFrame] = settled,
    **report,
) -> dict[str, DataFrame]:
    """The report straight from recorder tables: ``roles`` names each site's import and export series.

    ``roles``: keys and ``role``. Negative power counts as none; further arguments are those of
    :func:`payback_report`. ``provenance`` and ``refused`` are those of the load.
    """
    loaded = load_samples(
        roles, tables.meta, tables.statistics, tables.short_term, tables.states, "power", read, clamp=True, settle=settle
    )
    samples = loaded.samples.join(roles.select(*KEYS, "role").distinct(), list(KEYS)).drop("series_id")
    made = payback_report(samples, sizes, read.tz, **report)
    return made | {"provenance": loaded.provenance, "refused": loaded.refused}
