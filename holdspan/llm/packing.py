"""Bounded-space online packing of token ids into sequences of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import cut, texts
from holdspan.llm.encode import text_encoder

WINDOWS = 32  # open sequences a task keeps
FAN_IN = 16  # tasks whose leftovers are packed together
SLICE = 128  # texts encoded at once
PLACE_BITS = 36  # of the number of ids that a task has read; above them is the task

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "place", "open", "ids"]
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, "
    "place long, open boolean, ids binary"
)


class Packer:
    """Puts pieces of ids into at most ``windows`` open sequences, each by best fit.

    A piece goes to the open sequence with the least room that still holds it. If none does and no
    further one may be opened, the fullest is topped up with the head of the piece and leaves full, and
    the rest of the piece is placed again: so every sequence that leaves early has no padding.
    """

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.rooms: list[tuple[int, int]] = []  # (free ids, sequence), in order
        self.held: dict[int, list] = {}
        self.next = 0
        self.done: list[tuple] = []

    def _put(self, at: int | None, doc, start: int, ids: memoryview, total: int, place: int) -> None:
        """Append to the sequence at a place of ``rooms``, or to a new one."""
        n = len(ids) // 4
        if at is None:
            room, seq = self.capacity, self.next
            self.next += 1
            self.held[seq] = []
        else:
            room, seq = self.rooms.pop(at)
        self.held[seq].append((doc, start, ids, total, self.capacity - room, place))
        if room == n:
            self._out(self.done, False, self.held.pop(seq))
        else:
            insort(self.rooms, (room - n, seq))

    @staticmethod
    def _out(to: list[tuple], still: bool, pieces: list[tuple]) -> None:
        """A sequence is numbered by the first place among those of its pieces; no other one has it."""
        first = min(piece[-1] for piece in pieces)
        to.extend((first, still, *piece) for piece in pieces)

    def add(self, doc, ids: bytes | memoryview, start: int = 0, total: int | None = None, place: int = 0) -> None:
        """Place ids of a document; its ids before them are ``start``, all its ids ``total``.

        ``place`` is where the first id stands in the whole input.
        """
        ids = memoryview(ids)
        total = len(ids) // 4 if total is None else total
        while len(ids):
            n = len(ids) // 4
            take = n
            if n >= self.capacity:
                at, take = None, self.capacity
            else:
                at = bisect_left(self.rooms, (n, -1))
                if at == len(self.rooms):
                    at = None
                    if len(self.rooms) >= self.windows:
                        at, take = 0, self.rooms[0][0]
            self._put(at, doc, start, ids[: 4 * take], total, place)
            start, place, ids = start + take, place + take, ids[4 * take :]

    def leave(self) -> list[tuple]:
        """Pieces of the full sequences since the last call."""
        out, self.done = self.done, []
        return out

    def close(self) -> list[tuple]:
        """Pieces of the sequences still open."""
        out: list[tuple] = []
        for seq in sorted(self.held):
            self._out(out, True, self.held[seq])
        self.held, self.rooms = {}, []
        return out


def rows_of(pieces: list[tuple], part: int, with_ids: bool, final: bool = False) -> list[list]:
    """Columns of ``SCHEMA``; ids stay only where they are still needed, or are asked for."""
    columns: list[list] = [[] for _ in NAMES]
    for seq, still, doc, start, ids, total, offset, place in pieces:
        raw = bytes(ids)
        open_ = still and not final
        row = (
            doc, start, len(raw) // 4, zlib.crc32(raw), total, part, seq, offset, place, open_,
            raw if open_ or with_ids else None,
        )
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return columns


def _first_pass(path: str, end_id: int, capacity: int, windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = text_encoder(path)
        packer, part = Packer(capacity, windows), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        place = part << PLACE_BITS
        schema = pa.schema(
            [(n, pa.int64()) for n in NAMES[:9]] + [("open", pa.bool_()), ("ids", pa.binary())]
        )

        def batch_of(pieces):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows_of(pieces, part, with_ids), schema, strict=True)], schema=schema
            )

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = encoder.ids(text or "") + end
                    packer.add(doc, ids, place=place)
                    place += len(ids) // 4
                yield batch_of(packer.leave())
        yield batch_of(packer.close())

    return run


def _merge(capacity: int, windows: int, with_ids: bool, final: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "part", "seq", "offset"], ascending=[False, True, True, True])
        packer = Packer(capacity, windows)
        for row in rows.itertuples(index=False):
            doc = None if pd.isna(row.doc_id) else int(row.doc_id)
            packer.add(doc, row.ids, int(row.start), int(row.doc_tokens), int(row.place))
        columns = rows_of(packer.leave() + packer.close(), int(key[0]), with_ids, final)
        out = pd.DataFrame(dict(zip(NAMES, columns, strict=True)))
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    windows: int = WINDOWS,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all texts and their places in sequences of ``capacity`` ids.

    A text's ids and ``end_id`` after them are cut where that fills a sequence. Tasks pack what they
    read, in its order, and keep ``windows`` sequences open; what is left open at a task's end is packed
    again with that of ``FAN_IN`` tasks, and so on, until one sequence at most has padding. A merging task
    holds ``FAN_IN * windows`` sequences, whatever the corpus. Texts are not shuffled.

    Sequence numbers rise with the first id that a sequence holds, in the order of ``docs``' partitions
    and of the rows in them: of ordered documents, sequences are in that order.

    ``with_ids`` adds each piece's ids. A null or empty text is its ``end_id`` alone; null and repeated
    ids are packed each; an empty table gives no rows. Extra columns are not read.
    """
    narrow = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = cut(narrow.mapInArrow(_first_pass(path, end_id, capacity, windows, with_ids), SCHEMA))
    groups = packed.rdd.getNumPartitions()
    done = [packed.where("not open")]
    while True:
        groups = -(-groups // FAN_IN)
        final = groups <= 1
        left = packed.where("open").withColumn("group", F.floor(F.col("part") / FAN_IN))
        merge = _merge(capacity, 1 if final else windows, with_ids, final)
        packed = left.groupBy("group").applyInPandas(merge, SCHEMA)
        if final:
            done.append(packed)
            break
        packed = cut(packed)
        done.append(packed.where("not open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("seq").alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))
