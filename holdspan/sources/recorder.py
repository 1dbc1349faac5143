"""Recorder database files as a Spark data source.

Each file is one site. A table of a file is read in row-id ranges, one input partition each, with
the series and time filters pushed into the file's own query. Files must be on storage every
executor sees. Large fleets should land the tables as Parquet once and read that.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

# Columns taken from each table, with their Spark types; times and values are text
# where a file may hold any storage type, and are interpreted by the library's own expressions.
TABLES = {
    "statistics": {
        "id": "bigint", "metadata_id": "bigint", "start_ts": "double", "start": "string",
        "mean": "double", "min": "double", "max": "double", "state": "double", "sum": "double",
    },
    "states": {
        "state_id": "bigint", "metadata_id": "bigint", "entity_id": "string", "state": "string",
        "last_updated_ts": "double", "last_updated": "string",
        "last_changed_ts": "double", "last_changed": "string",
    },
    "statistics_meta": {"id": "bigint", "statistic_id": "string", "unit_of_measurement": "string"},
    "states_meta": {"metadata_id": "bigint", "entity_id": "string"},
}
TABLES["statistics_short_term"] = TABLES["statistics"]
ROWS_PER_PARTITION = 1_000_000
COMPARISONS = {
    EqualTo: "=",
    GreaterThan: ">",
    GreaterThanOrEqual: ">=",
    LessThan: "<",
    LessThanOrEqual: "<=",
}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _columns(conn: sqlite3.Connection, table: str) -> list[str]:
    return [row[1] for row in conn.execute(f'PRAGMA table_info("{table}")')]


class _Range(InputPartition):
    def __init__(self, site: int, path: str, low: int, high: int):
        self.site, self.path, self.low, self.high = site, path, low, high


class RecorderReader(DataSourceReader):
    def __init__(self, files: list[str], table: str, names: list[str], rows: int):
        self.files, self.table, self.names, self.rows = files, table, names, rows
        self.conditions: list[tuple[str, str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons on integer ids and epoch columns; text may compare differently."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            numeric = TABLES[self.table].get(column) in ("bigint", "double")
            if numeric and type(f) in COMPARISONS:
                self.conditions.append((column, COMPARISONS[type(f)] + " ?", [f.value]))
            elif numeric and isinstance(f, In):
                marks = ", ".join("?" for _ in f.value)
                self.conditions.append((column, f"IN ({marks})", list(f.value)))
            # Spark checks every filter again: a file may lack the column or hold other types.
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for site, path in enumerate(self.files):
            conn = _open(path)
            try:
                if _columns(conn, self.table):
                    low, high = conn.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                    if low is not None:
                        out += [
                            _Range(site, path, at, min(at + self.rows, high + 1))
                            for at in range(low, high + 1, self.rows)
                        ]
            finally:
                conn.close()
        return out or [_Range(-1, "", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.site < 0:
            return
        types = TABLES[self.table]
        conn = _open(part.path)
        try:
            present = set(_columns(conn, self.table))
            chosen = [f'"{n}"' if n in present else "NULL" for n in self.names[1:]]
            where, params = "rowid >= ? AND rowid < ?", [part.low, part.high]
            for column, test, values in self.conditions:
                if column in present:
                    where += f' AND "{column}" {test}'
                    params += values
            sql = f'SELECT {", ".join(chosen)} FROM "{self.table}" WHERE {where}'
            cast = [_CASTS[types[n]] for n in self.names[1:]]
            for row in conn.execute(sql, params):
                yield (part.site, *[c(v) for c, v in zip(cast, row)])
        finally:
            conn.close()


def _whole(value):
    return int(value) if isinstance(value, (int, float)) else None


def _real(value):
    if isinstance(value, (int, float)):
        return float(value)
    try:
        return float(value) if isinstance(value, str) else None
    except ValueError:
        return None


def _text(value):
    return None if value is None or isinstance(value, bytes) else str(value)


_CASTS = {"bigint": _whole, "double": _real, "string": _text}


class RecorderSource(DataSource):
    """``spark.read.format("recorder").option("table", ...).option("files", "a.db,b.db").load()``"""

    @classmethod
    def name(cls) -> str:
        return "recorder"

    def _table(self) -> str:
        table = self.options.get("table", "statistics")
        if table not in TABLES:
            raise ValueError(f"table must be one of {sorted(TABLES)}")
        return table

    def schema(self) -> str:
        columns = ", ".join(f"`{n}` {t}" for n, t in TABLES[self._table()].items())
        return f"site_id bigint, {columns}"

    def reader(self, schema) -> RecorderReader:
        files = [f for f in self.options.get("files", "").split(",") if f]
        rows = int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION))
        return RecorderReader(files, self._table(), schema.fieldNames(), rows)


def register(spark) -> None:
    """Make the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecorderSource)
