"""Token counts of whole texts: a broadcast table of frequent pieces, then a cache in each worker."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import texts
from holdspan.llm.encode import LONGEST, PieceCache, WholeCounter, cuts_at_spaces, length, pieces, worker_cache

FREQUENT = 65_536  # pieces in the broadcast table: at most 13 M characters, a few MB in practice
SAMPLE = 4_000  # texts from which that table is chosen; it is a cache, so the counts do not depend on it
SLICE = 256  # texts handled at once


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample: int = SAMPLE, most: int = FREQUENT) -> dict:
    """Token counts of the most frequent pieces of some texts.

    Both bounds are parameters: about ``sample`` texts, drawn over the whole table, are cut up and
    ``most`` pieces reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0).to_pylist():
                seen.update(p for p in pieces(value)[1:] if len(p) <= LONGEST)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"]
            )

    every = docs.select(F.col(text).alias("text"))
    some = every.sample(min(1.0, sample / max(1, every.count())), 7).where("text is not null")
    best = (
        some.mapInArrow(count, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(most)
    )
    return PieceCache(path, length).encode([row.piece for row in best.select("piece").collect()])


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent: dict | None = None,
) -> DataFrame:
    """Bytes and tokens of every text, and whether there are more than ``limit`` tokens.

    No shuffle: a task reads its texts, looks pieces up in the broadcast table, then in its own cache,
    and encodes the rest. A null text counts as empty, a null id is kept, repeated rows are counted each;
    an empty table gives no rows. Extra columns are not read.

    A ``path`` whose texts cannot be cut at spaces (``.model``, ``.tiktoken``, ``.json`` of another build) has
    its texts encoded whole, without the table. A file of no known kind is refused at once.
    """
    if not cuts_at_spaces(path):
        WholeCounter(path)
        given = None
    else:
        given = frequent_lengths(docs, path, text) if frequent is None else frequent
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def count(batches: Iterator[pa.RecordBatch]):
        cache = worker_cache(path, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                whole = [t or "" for t in part.column(1).to_pylist()]
                tokens = [sum(row) for row in cache.texts(whole)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in whole], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
