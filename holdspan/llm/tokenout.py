"""Token ids as packed matrices: best-fit-decreasing over a segment tree of free room."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import texts
from holdspan.llm.encode import text_encoder

SLICE = 128  # texts encoded at once
BLOCK_TOKENS = 4_000_000  # ids that are packed together: 16 MB


class Rooms:
    """Open rows by free room, in a segment tree whose leaves are the rooms 0..capacity.

    A node says how many open rows lie below it, so the least sufficient room is found, and a row moved,
    in as many steps as the tree is high.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room that is at least ``least``."""
        count, at = self.count, least + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right neighbour holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Piece numbers of each row; a piece is at most ``capacity`` long."""
    rooms, rows = Rooms(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = rooms.take(n)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > n:
            rooms.add(room - n, row)
    return rows


FIELDS = [
    ("matrix_id", pa.int64()),
    ("row", pa.int64()),
    ("ids", pa.binary()),
    ("n_tokens", pa.int64()),
    ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())),
]
SCHEMA = (
    "matrix_id long, row long, ids binary, n_tokens long, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>"
)


def _matrix(docs: list, encoded: list[bytes], number: int, capacity: int, pad: int) -> pa.RecordBatch:
    """One packed matrix, a row of the result for each of its rows."""
    of, starts, ids = [], [], []
    for doc, raw in zip(docs, encoded, strict=True):
        for at in range(0, len(raw), 4 * capacity):
            of.append(doc)
            starts.append(at // 4)
            ids.append(memoryview(raw)[at : at + 4 * capacity])
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    columns: list[list] = [[] for _ in FIELDS]
    fill = pad.to_bytes(4, "little")
    for row, members in enumerate(best_fit_decreasing(lengths, capacity)):
        ends = [0, *np.cumsum(lengths[members]).tolist()]
        # Positions start again at 0 with each segment, a split document's rest among them.
        values = (
            number, row, b"".join(ids[m] for m in members) + fill * (capacity - ends[-1]), ends[-1], ends,
            ends[:-1], [of[m] for m in members], [starts[m] for m in members],
        )
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS]
    )


def token_matrices(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 50256,
    pad_id: int = 0,
    block_tokens: int = BLOCK_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of packed id matrices of ``capacity`` columns.

    ``ids`` holds the row as little-endian unsigned 32-bit numbers, padded at its end; ``cu_seqlens`` the
    cumulative lengths of its segments from 0; ``position_resets`` where positions start again at 0;
    ``doc_ids`` and ``starts`` name each segment's document and how many of its ids come before. A
    document longer than a row is split into whole rows and a rest, and no id is lost. Every
    ``block_tokens`` ids a task packs and writes a matrix, so its memory does not grow; nothing is shuffled.

    A null or empty text is its ``end_id`` alone; null and repeated ids are packed each; an empty table
    gives no rows. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = text_encoder(path)
        end, task, made = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        held_docs: list = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    raw = encoder.ids(text or "") + end
                    held_docs.append(doc)
                    held.append(raw)
                    size += len(raw) // 4
                    if size >= block_tokens:
                        yield _matrix(held_docs, held, (task << 32) + made, capacity, pad_id)
                        held_docs, held, size, made = [], [], 0, made + 1
        if held:
            yield _matrix(held_docs, held, (task << 32) + made, capacity, pad_id)

    narrow = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, path: str, folder: str, **options) -> DataFrame:
    """Write the matrices as Parquet to a shared folder and read them back."""
    token_matrices(docs, path, **options).write.mode("errorifexists").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row's ids, from 0 in each segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
