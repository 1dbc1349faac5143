"""Which series exist, what they hold, which table answers for them, and what to suggest instead.

Statistics and meta tables are keyed ``(site_id, metadata_id)``; the counts are aggregated on the
id before any join, so a busy series is one row by the time it is named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdspan import KEYS
from holdspan.functions.values import floor_timestamp, quantity_of, trimmed

ID = ("site_id", "metadata_id")
SOURCE_ORDER = ("statistics", "short_term", "states")
# How many replacements and how many ids are suggested, and the shortest word tried.
REPLACEMENTS = 5
SUGGESTIONS = 10
MIN_WORD = 3


def series_matching(ids: DataFrame, domain: str, words: Sequence[str], column: str = "series_id") -> DataFrame:
    """Distinct ids of a domain that contain any of the words, whatever their case."""
    found = F.lit(False)
    for word in words:
        found = found | F.col(column).ilike(f"%{word}%")
    own = ids.filter(F.col(column).ilike(f"{domain}.%") & found)
    return own.select("site_id", column).distinct()


def row_summary(statistics: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Rows, means, totals and first and last time per series id."""
    ts = floor_timestamp(F.col("start_ts").cast("double"))
    return statistics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("mean").alias("means"),
        F.count("sum").alias("sums"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def series_catalog(meta: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row per known series, also for those without any statistics rows."""
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "means", "sums")]
    return meta.join(row_summary(statistics), list(ID), "left").select(
        *KEYS, "unit", *counts, "first_ts", "last_ts"
    )


def series_kind(catalog: DataFrame) -> DataFrame:
    """The catalogue with what each series holds, judged by its rows and never by flags.

    ``quantity`` is set where the series can be read as one; ``rank_group`` orders power, then
    temperature, energy counters, the rest.
    """
    has_mean, has_sum = F.col("means") > 0, F.col("sums") > 0
    kind = (
        F.when(has_mean & has_sum, "mean_total")
        .when(has_mean, "mean")
        .when(has_sum, "total")
        .otherwise("empty")
    )
    readable = F.when(has_mean & (F.col("rows") > 0), quantity_of(F.col("unit")))
    counter = has_sum & F.coalesce(trimmed(F.col("unit")).endswith("Wh"), F.lit(False))
    group = (
        F.when(F.col("quantity") == "power", 0)
        .when(F.col("quantity") == "temperature", 1)
        .when(F.col("energy_counter"), 2)
        .otherwise(3)
    )
    return (
        catalog.withColumn("kind", kind)
        .withColumn("quantity", readable)
        .withColumn("energy_counter", counter)
        .withColumn("rank_group", group)
    )


def catalog_listing(catalog: DataFrame) -> DataFrame:
    """The catalogue in listing order: site, group, most rows, id."""
    return series_kind(catalog).orderBy("site_id", "rank_group", F.desc("rows"), "series_id")


def value_count(statistics: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per series and how many carry a value in ``column``."""
    return statistics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(column).alias("values")
    )


def resolve_source(
    requests: DataFrame,
    meta: DataFrame,
    statistics: DataFrame,
    short_term: DataFrame,
    states: DataFrame,
) -> DataFrame:
    """The table that answers for each requested series.

    Statistics if they have any row, else short-term ones, else raw states that know the series.
    Rows without a usable value still end the search: a counter must never fall through to its
    climbing states. A series nobody knows is left to the statistics.
    """

    def tagged(rows: DataFrame, keys: Sequence[str], rank: int) -> DataFrame:
        return rows.select(*keys).distinct().withColumn("_rank", F.lit(rank))

    recorded = tagged(statistics, ID, 0).unionByName(tagged(short_term, ID, 1))
    named = recorded.join(meta.select(*ID, "series_id"), list(ID)).select(*KEYS, "_rank")
    ranks = (
        named.unionByName(tagged(states, KEYS, 2)).groupBy(*KEYS).agg(F.min("_rank").alias("_rank"))
    )
    source = F.element_at(
        F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.coalesce("_rank", F.lit(0)) + 1
    )
    return requests.join(ranks, list(KEYS), "left").select(
        *requests.columns, source.alias("source"), F.col("_rank").isNotNull().alias("known")
    )


def diagnose_empty(requests: DataFrame, catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """Requested series without any sample, and why: unknown, no_rows, no_values or outside_window."""
    answered = samples.select(*KEYS).distinct()
    reason = (
        F.when(F.col("rows").isNull(), "unknown")
        .when(F.col("rows") == 0, "no_rows")
        .when(F.col("means") == 0, "no_values")
        .otherwise("outside_window")
    )
    return (
        requests.select(*KEYS)
        .distinct()
        .join(answered, list(KEYS), "left_anti")
        .join(catalog, list(KEYS), "left")
        .select(*KEYS, reason.alias("reason"), "unit", "rows", "means", "first_ts", "last_ts")
    )


def suggest_replacements(
    wanted: DataFrame, catalog: DataFrame, quantity: str, limit: int = REPLACEMENTS
) -> DataFrame:
    """For each wanted id, the readable series of the quantity with the longest common prefix.

    ``wanted``: site_id, wanted. Ties go to the most rows, then to the id. Candidates meet a wanted
    id only through the prefixes both share, and each prefix keeps its ``limit`` best candidates: a
    candidate below those has ``limit`` better ones for every id of that prefix, so nothing is lost.
    """
    readable = series_kind(catalog).filter(F.col("quantity") == quantity)

    def prefixes(name: Column) -> Column:
        lengths = F.sequence(F.lit(0), F.length(name))
        return F.explode(F.transform(lengths, lambda n: F.substring(name, F.lit(1), n)))

    asked = wanted.select("site_id", "wanted", prefixes(F.lower("wanted")).alias("prefix"))
    offered = readable.select(
        "site_id", "series_id", "rows", prefixes(F.lower("series_id")).alias("prefix")
    ).join(asked.select("site_id", "prefix").distinct(), ["site_id", "prefix"], "left_semi")
    best = Window.partitionBy("site_id", "prefix").orderBy(F.desc("rows"), "series_id")
    leaders = offered.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= limit)
    pairs = (
        asked.join(leaders, ["site_id", "prefix"])
        .groupBy("site_id", "wanted", "series_id", "rows")
        .agg(F.max(F.length("prefix")).alias("shared"))
    )
    order = Window.partitionBy("site_id", "wanted").orderBy(F.desc("shared"), F.desc("rows"), "series_id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def id_patterns(needle: str) -> list[str]:
    """What is looked for in turn: the id, its part after the domain, its longest word."""
    patterns = [needle]
    if "." in needle:
        patterns.append(needle.split(".", 1)[1])
    words = needle
    for mark in "._- ":
        words = words.replace(mark, "\n")
    # Of several longest words the last one counts.
    longest = max(reversed(words.split("\n")), key=len)
    if len(longest) >= MIN_WORD:
        patterns.append(longest)
    return patterns


def suggest_ids(ids: DataFrame, needles: Sequence[str], limit: int = SUGGESTIONS) -> DataFrame:
    """Known ids like each of the typed ``needles``, by the first pattern that finds any.

    The needles are a parameter, so their patterns are tested where the ids are scanned and only
    matches leave it; ranking keeps ``limit`` per needle and pattern before the shuffle.
    """
    tests = [
        F.when(
            F.col("series_id").ilike(f"%{pattern}%"),
            F.struct(F.lit(needle).alias("needle"), F.lit(rank).alias("pattern")),
        )
        for needle in needles
        for rank, pattern in enumerate(id_patterns(needle))
    ]
    hits = ids.select("site_id", "series_id", F.explode(F.array_compact(F.array(*tests))).alias("_hit"))
    found = hits.select("site_id", "series_id", "_hit.*").distinct()
    first = Window.partitionBy("site_id", "needle", "pattern").orderBy("series_id")
    top = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    pattern = Window.partitionBy("site_id", "needle").orderBy("pattern")
    return (
        top.withColumn("_tier", F.dense_rank().over(pattern))
        .filter("_tier = 1")
        .select("site_id", "needle", "pattern", "place", "series_id")
    )
