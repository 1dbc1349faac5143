"""Cutting a lineage that several results branch from."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder the session names in ``spark.checkpoint.dir``, or was given.

    That folder is shared, so the rows outlive any executor. Without one the plan is left as it is:
    Spark then computes the branches again, which is slower but as safe.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        warnings.warn("spark.checkpoint.dir is not set: shared branches are computed again", stacklevel=2)
    return df.checkpoint() if folder else df
