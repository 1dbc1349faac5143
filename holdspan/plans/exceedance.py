"""The exceedance report: readings to reliable hours in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from holdspan import KEYS
from holdspan.options import GridOptions, ReadOptions
from holdspan.operators import coverage, grid
from holdspan.operators.settle import settled
from holdspan.sources.load import Tables, load_samples


def exceedance_report(
    samples: DataFrame,
    tz: str | Column,
    options: GridOptions = GridOptions(),
    gap_threshold: int = 86_400,
    keys: Sequence[str] = KEYS,
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Every table of the report, all from one cube per series, day, hour and bucket.

    Probabilities are step functions over the axis, a row for each bucket that was seen.

    ``settle`` is applied to the cube before the tables branch off it: pass
    :func:`holdspan.operators.settle.settled` when many are wanted, so that samples are cut once.
    """
    step, g = options.step, options.grouping
    cube = settle(grid.exposure_cube(samples, tz, step, keys))
    if options.max_value is None:
        axis = grid.axis_from_cube(cube, step, options.quantile, keys)
    else:
        axis = grid.fixed_axis(samples, step, options.max_value, keys)
    faceted = grid.with_grouping(cube, g)
    span = coverage.spans(samples, tz, keys)
    possible = coverage.possible_days(span, g, keys)
    steps = grid.exceedance_steps(grid.exposure_grid(faceted, axis, ("facet",), keys), ("facet",), step, keys)
    columns = grid.facet_columns(cube, possible, g, options.min_days, keys)
    ask = (step, options.threshold, options.probability, options.min_days)
    windows = grid.reliable_window(faceted, axis, *ask, ("facet",), keys)
    halves = grid.with_grouping(cube, "half_year")
    summary = coverage.coverage_summary(
        span,
        grid.full_days(cube, keys=keys),
        coverage.outages(samples, gap_threshold, keys),
        coverage.missing_facets(span, faceted, g, keys),
        keys,
    )
    return {
        "axis": axis,
        "probabilities": steps,
        "columns": columns,
        "pooled_columns": grid.pooled_columns(cube, options.min_days, keys),
        "season_columns": grid.season_columns(cube, options.min_days, keys),
        "windows": windows,
        "overall_window": grid.reliable_window(cube, axis, *ask, (), keys),
        "season_windows": grid.reliable_window(halves, axis, *ask, ("facet",), keys),
        "never_reaching": grid.facets_never_reaching(windows),
        "table": grid.probability_table(steps, columns, axis, step, options.metric, keys),
        "coverage": coverage.coverage_flags(summary),
    }


def recorded_exceedance(
    requests: DataFrame,
    tables: Tables,
    read: ReadOptions = ReadOptions(),
    options: GridOptions = GridOptions(),
    settle: Callable[[DataFrame], DataFrame] = settled,
) -> dict[str, DataFrame]:
    """The report straight from recorder tables, for the requested power series, with where they came from.

    Negative power counts as none. ``provenance`` and ``refused`` are those of the load.
    """
    loaded = load_samples(
        requests, tables.meta, tables.statistics, tables.short_term, tables.states, "power", read, clamp=True, settle=settle
    )
    report = exceedance_report(loaded.samples, read.tz, options, read.gap_threshold, settle=settle)
    return report | {"provenance": loaded.provenance, "refused": loaded.refused}
