"""Where queries and their oracles are gathered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import TEXT, Fixtures, duck, rooms_sql, SHARED_ROOMS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6

# Named parts of the oracles; a query's WITH clause holds just those it mentions.
CTES: dict[str, str] = {name: duck(name) for name in TEXT}
CTES["dim_rooms"] = rooms_sql()
CTES["dim_shared"] = rooms_sql(SHARED_ROOMS)
GIVEN: dict[str, tuple] = {}  # what each query was registered with


def part(name: str, sql: str) -> None:
    """Define a named part of the oracles."""
    CTES[name] = sql


def _needed(sql: str, seen: list[str], parts: dict[str, str]) -> list[str]:
    for name in parts:
        if name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
            _needed(parts[name], seen, parts)
            if name not in seen:
                seen.append(name)
    return seen


def oracle(sql: str, recursive: str = "", other: dict[str, str] | None = None) -> str:
    """A SELECT with the parts it needs; ``other`` stands in for parts of the same name."""
    ctes = CTES | (other or {})
    names = _needed(sql + recursive, [], ctes)
    parts = [f"{n} as materialized ({ctes[n]})" for n in names]
    if recursive:
        parts.append(recursive)
    if not parts:
        return sql
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + sql


def r(expr: str, places: int = PLACES) -> str:
    """A real number of the oracle, rounded, without a negative zero."""
    return f"(round(cast({expr} as double), {places}) + 0.0::double)"


def comparable(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Real numbers rounded, dates and arrays as text: values that compare across engines."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, places) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(key: str, sql: str | None = None, recursive: str = "", places: int = PLACES):
    """Register a query over :class:`Fixtures`, with its oracle."""

    def add(build: Callable[[Fixtures], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: comparable(build(Fixtures(spark, sf_dir)), places)
        if sql is not None:
            ORACLES[key] = oracle(sql, recursive)
        GIVEN[key] = (build, sql, recursive, places)
        return build

    return add


def whole(key: str, fixtures: dict[str, str], parts: dict[str, str] | None = None, build=None) -> None:
    """Register ``key`` a second time as ``key_whole``, over ``fixtures`` in place of those of the same name."""
    given, sql, recursive, places = GIVEN[key]
    build = build or given
    other = {name: duck(name, text) for name, text in fixtures.items()} | (parts or {})
    QUERIES[f"{key}_whole"] = lambda spark, sf_dir: comparable(build(Fixtures(spark, sf_dir, fixtures)), places)
    ORACLES[f"{key}_whole"] = oracle(sql, recursive, other)
