"""Result tables to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # directories of sites: few and large files however many sites a fleet has
PLACES = ("site_bucket", "part_month")


def _placed(table: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
    """The table with the columns its files are laid out by."""
    by = {}
    if "site_id" in table.columns:
        by["site_bucket"] = F.pmod(F.xxhash64(F.col("site_id").cast("string")), F.lit(buckets)).cast("int")
    if "day" in table.columns:
        by["part_month"] = F.date_format("day", "yyyy-MM")
    elif "start_ts" in table.columns:
        by["part_month"] = F.date_format(F.timestamp_seconds("start_ts"), "yyyy-MM")
    return table.withColumns(by) if by else table, list(by)


def write_tables(tables: dict[str, DataFrame], folder: str, buckets: int = BUCKETS) -> None:
    """Each table below ``folder`` under its name, by bucket of sites and by month where it has these.

    Only the buckets and months that a table holds are written anew, so a load may bring one month of
    all sites, or all sites of a bucket; others stay. Rows are gathered by these columns first, with
    adaptive execution free to split a large one. Output is committed by the writer as a whole.
    """
    for name, table in tables.items():
        placed, by = _placed(table, buckets)
        out = placed.hint("rebalance", *by) if by else placed
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it was written; a filter on site bucket or month must come before."""
    return spark.read.parquet(f"{folder}/{name}").drop(*PLACES)
