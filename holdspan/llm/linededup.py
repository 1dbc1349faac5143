"""Lines that many documents share: sharded cuckoo filters before exact reference counts.

The index is three kinds of tables in a shared folder. ``refs`` are the exact references (line, document)
as a log of additions and removals, ``counts`` the number of documents and the largest one for each
line, ``filters`` a cuckoo filter for each shard of lines. New lines are looked up in their shard's
filter; only those that it may hold are counted again from the references. Deleting a document takes
its references back, and a line that nobody holds leaves its filter: so every step can be undone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdspan.llm.common import WHITE, ascii_lower, cut, texts, unused
from holdspan.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_LINES = 250_000  # distinct lines of a shard: a filter of 1 MB, and a task of a few tens of MB
SLICE = 256  # texts handled at once
BATCHES = 4  # parts in which ``load`` inserts: the later ones meet the filters of the earlier ones

KEY = ["h1", "h2"]
ADDED = ["_kept", "_n_lines", "_n_dropped", "_kept_sha256"]
COUNTS = "shard int, h1 long, h2 long, n_docs long, last_doc long"
FILTERS = "shard int, lines long, slots binary"


def line_key(line: str) -> str:
    """What makes lines equal."""
    return ascii_lower(line.strip(WHITE))


def _digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc_id`` for the distinct long lines of each row that has an id."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                digests, ids = [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    keys = {k for k in map(line_key, (text or "").split("\n")) if len(k) >= min_chars}
                    digests.extend(map(_digest, keys))
                    ids.extend([doc] * len(keys))
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"]
                )

    narrow = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return narrow.mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineIndex:
    """An index in ``folder``, which all executors share. Every change writes new tables and then counts.

    ``shards`` is fixed when the index is made or loaded; ``expected`` lines choose it.
    """

    def __init__(self, spark: SparkSession, folder: str, expected: int = 0, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.folder = spark, folder
        self.min_chars, self.min_docs = min_chars, min_docs
        self.shards = _shards(expected)
        self.version = 0
        self.logs: list[str] = []
        self.plain = True  # each reference stands in the log once

    @classmethod
    def temporary(cls, spark: SparkSession, expected: int = 0, **options) -> LineIndex:
        """An index beside the session's checkpoints."""
        cut(spark.range(0))  # makes sure of a checkpoint folder
        folder = spark.sparkContext.getCheckpointDir()
        return cls(spark, f"{folder}/lines-{uuid.uuid4().hex}", expected, **options)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}-{self.version}")

    @property
    def counts(self) -> DataFrame:
        """``shard, h1, h2, n_docs, last_doc`` of every line held."""
        return self._read("counts", COUNTS)

    @property
    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    @property
    def refs(self) -> DataFrame:
        """``h1, h2, doc_id, times`` of every reference that stands, and how often it was added."""
        schema = "h1 long, h2 long, doc_id long, change int"
        if not self.logs:
            return self.spark.createDataFrame([], schema).withColumnRenamed("change", "times")
        log = self.spark.read.schema(schema).parquet(*self.logs)
        if self.plain:
            return log.withColumnRenamed("change", "times")
        return log.groupBy(*KEY, "doc_id").agg(F.sum("change").alias("times")).where("times > 0")

    def _shard(self):
        return F.pmod(F.shiftrightunsigned("h2", 20), F.lit(self.shards)).cast("int").alias("shard")

    def _log(self, refs: DataFrame, change: Column) -> DataFrame:
        path = f"{self.folder}/refs-{len(self.logs) + 1}"
        refs.select(*KEY, "doc_id", change.cast("int").alias("change")).write.parquet(path)
        self.plain = not self.logs
        self.logs.append(path)
        return self.spark.read.parquet(path)

    def _count(self, refs: DataFrame) -> DataFrame:
        counted = refs.groupBy(*KEY).agg(
            F.count("*").alias("n_docs"),
            F.max("doc_id").alias("last_doc"),
        )
        return counted.select(self._shard(), *KEY, "n_docs", "last_doc")

    def _write(self, counts: DataFrame, filters: DataFrame) -> None:
        new = self.version + 1
        counts.write.parquet(f"{self.folder}/counts-{new}")
        filters.write.parquet(f"{self.folder}/filters-{new}")
        self.version = new

    def insert(self, docs: DataFrame) -> None:
        """Add the documents' lines; a document that is there already gains what is new."""
        added = self._log(references(docs, self.min_chars).distinct(), F.lit(1))
        looked_up = cut(_look_up(self._count(added), self.filters))
        known = looked_up.where("seen").select(*KEY)
        # Lines that the filters may hold are counted again from the references.
        self._merge(looked_up, known, self._count(self.refs.join(known, KEY, "left_semi")))

    def load(self, docs: DataFrame, batches: int = BATCHES) -> None:
        """Fill a new index with ``docs``, in ``batches`` parts by the documents' ids.

        Texts are cut into lines once. No document is in two parts, so a line that the filter may hold
        only adds to the count that is there, and one that it does not hold is new without a look at
        the counts. The number of references sets the number of shards.
        """
        if self.logs:
            raise ValueError("only a new index is loaded")
        staged = f"{self.folder}/staged"
        part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
        found = references(docs, self.min_chars).distinct()
        found.select(*KEY, "doc_id", F.lit(1).alias("change"), part.alias("part")).write.partitionBy("part").parquet(staged)
        schema = "h1 long, h2 long, doc_id long, change int, part int"
        stored = self.spark.read.schema(schema).parquet(staged)
        sizes = {row.part: row.n for row in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}
        self.shards = _shards(sum(sizes.values()))
        self._write(self.counts, self.filters)
        for k in sorted(sizes):
            looked_up = cut(_look_up(self._count(stored.where(F.col("part") == k)), self.filters).coalesce(self.shards))
            self._add(looked_up, len(sizes))
            self.logs.append(f"{staged}/part={k}")

    def _add(self, looked_up: DataFrame, room: int) -> None:
        """Counts with the new lines of ``looked_up`` as they are and with those that were seen added to their own.

        Tables have a file a shard, however many partitions a shuffle has.
        """
        path = f"{self.folder}/counts-{self.version + 1}"
        marked = looked_up.withColumn("new", F.lit(True))
        known, fresh = marked.where("seen").drop("seen"), marked.where("not seen").drop("seen")
        summed = self.counts.withColumn("new", F.lit(False)).unionByName(known).groupBy("shard", *KEY).agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.min("new").alias("new")
        )
        summed.unionByName(fresh).coalesce(self.shards).write.parquet(path)
        counts = self.spark.read.schema(COUNTS + ", new boolean").parquet(path)
        # The filters gain exactly the lines that the counts did not hold: fresh ones and false alarms.
        filters = _filled(counts.where("new").select("shard", *KEY), self.filters, counts, room, self.shards)
        filters.write.parquet(f"{self.folder}/filters-{self.version + 1}")
        self.version += 1

    def _merge(self, looked_up: DataFrame, known: DataFrame, again: DataFrame) -> None:
        """Counts with the new lines of ``looked_up`` as they are and with ``again`` for the ``known`` ones."""
        fresh = looked_up.where("not seen").drop("seen")
        counts = cut(self.counts.join(known, KEY, "left_anti").unionByName(again).unionByName(fresh))
        # The filters gain exactly the lines that the counts did not hold: fresh ones and false alarms.
        alarms = again.select("shard", *KEY).join(self.counts.select(*KEY), KEY, "left_anti")
        new = fresh.select("shard", *KEY).unionByName(alarms)
        self._write(counts, _filled(new, self.filters, counts))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take back all references of the documents in ``doc_ids`` (``doc_id``)."""
        gone = self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        touched = self._log(cut(gone), -F.col("times")).select(*KEY).distinct()
        again = self._count(self.refs.join(touched, KEY, "left_semi"))
        counts = cut(self.counts.join(touched, KEY, "left_anti").unionByName(again))
        lost = self.counts.join(counts.select(*KEY), KEY, "left_anti")
        self._write(counts, _emptied(lost, self.filters))

    def shared(self) -> DataFrame:
        """``h1, h2, last_doc`` of the lines in at least ``min_docs`` documents."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select(*KEY, "last_doc")

    def dropped(self, docs: DataFrame | None = None) -> DataFrame:
        """``doc_id, drop``: digests of the lines that each of ``docs`` loses; only documents that lose any.

        Without ``docs`` those of all documents held, from the references.
        """
        asked = self.refs.select(*KEY, "doc_id") if docs is None else references(docs, self.min_chars)
        held = asked.join(self.shared(), KEY).where("doc_id < last_doc")
        both = F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in KEY])
        return held.groupBy("doc_id").agg(F.collect_set(both).alias("drop"))

    def apply(self, docs: DataFrame, whole: bool = False) -> DataFrame:
        """All rows and columns of ``docs``, and ``_kept`` text, ``_n_lines``, ``_n_dropped``.

        ``whole`` says that ``docs`` are the documents held, so their lines need not be cut again. A row whose id is null keeps all its lines; a null text is one empty line and stays null. Columns
        of ``docs`` that have the names of those added are replaced.
        """
        docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
        of, drop = unused(docs, "_of"), unused(docs, "_drop")
        drops = self.dropped(None if whole else docs).select(F.col("doc_id").alias(of), F.col("drop").alias(drop))
        joined = docs.join(drops, F.col("doc_id").cast("long") == F.col(of), "left").drop(of)
        return _without(joined, self.min_chars, drop)


def _shards(lines: int) -> int:
    return 1 << max(3, (lines // SHARD_LINES).bit_length())


def _look_up(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The counts of ``batch``, and ``seen``: whether the shard's filter may hold the line."""

    def run(key: tuple, lines: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = lines.copy()
        if len(stored) and len(out):
            out["seen"] = CuckooFilter.of_bytes(stored["slots"].iloc[0]).contains(out["h1"].to_numpy().view(np.uint64))
        else:
            out["seen"] = False
        return out

    return batch.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, COUNTS + ", seen boolean")


def _filled(
    new: DataFrame, filters: DataFrame, counts: DataFrame | None = None, room: int = 1, shards: int = 0
) -> DataFrame:
    """The filters with the lines of ``new``; one that is too full is built again from ``counts``.

    A new filter has room for ``room`` times its lines. ``shards``, if given, bounds the tasks.
    """

    def run(key: tuple, lines: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        digests = lines["h1"].to_numpy().view(np.uint64)
        held = int(stored["lines"].iloc[0]) if len(stored) else 0
        total = held + len(digests)
        if held:
            table = CuckooFilter.of_bytes(stored["slots"].iloc[0])
            fits = total <= table.table.size * 0.9 and table.insert(digests)
        else:
            table, fits = CuckooFilter.sized(total * room), True
            while not table.insert(digests):
                table = CuckooFilter.sized(2 * table.table.size)
        return pd.DataFrame({"shard": [key[0]], "lines": [total], "slots": [table.tobytes() if fits else None]})

    grown = new.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, FILTERS)
    if counts is None:
        return grown
    grown = cut(grown.coalesce(shards) if shards else grown)
    full = grown.where("slots is null").select("shard")
    if full.isEmpty():
        return grown
    none = filters.limit(0)
    rebuilt = _filled(counts.join(full, "shard", "left_semi"), none)
    return grown.where("slots is not null").unionByName(rebuilt)


def _emptied(lost: DataFrame, filters: DataFrame) -> DataFrame:
    """The filters without the lines of ``lost``."""

    def run(key: tuple, lines: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(stored):
            return stored
        table = CuckooFilter.of_bytes(stored["slots"].iloc[0])
        table.delete(lines["h1"].to_numpy().view(np.uint64))
        left = int(stored["lines"].iloc[0]) - len(lines)
        return pd.DataFrame({"shard": [key[0]], "lines": [left], "slots": [table.tobytes()]})

    return lost.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, FILTERS)


def _without(docs: DataFrame, min_chars: int, drops: str) -> DataFrame:
    """``docs`` (with digests to drop in the column ``drops``) and what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                kept, lines, dropped = [], [], []
                given = some.column(some.schema.get_field_index("text")).to_pylist()
                for text, drop in zip(given, some.column(some.schema.get_field_index(drops)).to_pylist(), strict=True):
                    cut_up = (text or "").split("\n")
                    lines.append(len(cut_up))
                    if drop:
                        gone = set(drop)
                        left = [x for x in cut_up if not _falls(x, gone, min_chars)]
                        dropped.append(len(cut_up) - len(left))
                        text = "\n".join(left)
                    else:
                        dropped.append(0)
                    kept.append(text)
                digests = [hashlib.sha256((k or "").encode()).hexdigest() for k in kept]
                own = [some.column(i) for i, f in enumerate(some.schema) if f.name != drops]
                names = [f.name for f in some.schema if f.name != drops]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)],
                    [*names, *ADDED],
                )

    docs = texts(docs)
    fields = [f for f in docs.schema.fields if f.name != drops]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, schema + ", _kept string, _n_lines long, _n_dropped long, _kept_sha256 string")


def _falls(line: str, gone: set[bytes], min_chars: int) -> bool:
    key = line_key(line)
    return len(key) >= min_chars and _digest(key) in gone


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Index all rows of ``docs`` and drop the lines they share.

    Lines whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents
    stay only in the document with the largest id. All rows and columns come back, with ``_kept``,
    ``_n_lines``, ``_n_dropped``, ``_kept_sha256``, which replace columns of the same names. Documents go in
    by batches, and the filters tell lines met before from new ones. Rows without id count for no line and lose none; rows that repeat an id are one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    index = LineIndex.temporary(spark, min_chars=min_chars, min_docs=min_docs)
    index.load(docs)
    return index.apply(docs, whole=True)
