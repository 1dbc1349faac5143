"""A least-squares line on any grouping, with the rules for when there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_POINTS = 3


def fit_line(x: Column, y: Column, min_spread: float) -> Column:
    """Aggregate: ``struct(slope, base, r2, slope_error, points)``, NULL with too few or too close points.

    Pass NULL in ``x`` or ``y`` to leave a row out.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    n = F.regr_count(py, px)
    sxx = F.nullif(F.regr_sxx(py, px), F.lit(0.0))
    syy, sxy = F.regr_syy(py, px), F.regr_sxy(py, px)
    residual = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    r2 = F.when(syy > 0, F.greatest(F.lit(1.0) - residual / F.nullif(syy, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(1.0))
    spread = F.max(px) - F.min(px)
    line = F.struct(
        (sxy / sxx).alias("slope"),
        (F.avg(py) - sxy / sxx * F.avg(px)).alias("base"),
        r2.alias("r2"),
        F.sqrt(residual / F.nullif(n - 2, F.lit(0).cast("bigint")) / sxx).alias("slope_error"),
        n.alias("points"),
    )
    return F.when((n >= MIN_POINTS) & (spread >= min_spread), line)
