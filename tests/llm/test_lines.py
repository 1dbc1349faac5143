"""Line dedup against a loop, its index forwards and backwards, and the filter."""

import os
import random

import numpy as np
import pytest
from llmfixtures import documents  # noqa: F401
from pyspark.sql import functions as F

from holdspan.llm import linededup
from holdspan.llm.common import WHITE
from holdspan.llm.cuckoo import CuckooFilter

LONG = [f"A line number {i} that is long enough to count for something" for i in range(12)]


def corpus(seed):
    random.seed(seed)
    rows = []
    for i in range(60):
        lines = [random.choice(["", " ", "\t", "\x1c"]) + random.choice(LONG + ["short", ""]) for _ in range(random.randint(0, 8))]
        lines = [x.upper() if random.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return [*rows, (60, None), (61, ""), (None, LONG[0]), (5, "\n".join(LONG)), (62, ("x" * 39 + "\n") * 9), (63, "y" * 90_000)]


def shared_lines(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = linededup.line_key(line)
            if doc is not None and len(k) >= 40:
                holders.setdefault(k, set()).add(doc)
    return {k: max(v) for k, v in holders.items() if len(v) >= 5}


def left_of(rows):
    shared, out = shared_lines(rows), []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or shared.get(linededup.line_key(x), doc) == doc]
        out.append((str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r._n_lines, r._n_dropped, r._kept or "") for r in df.collect())


def test_key():
    assert linededup.line_key(" \t\x0bÄB c\r") == "Äb c" and linededup.line_key("\x1cA") == "\x1ca" and WHITE.strip(WHITE) == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup(documents, seed):
    rows = corpus(seed)
    docs = documents(rows).withColumnRenamed("lang", "drop").withColumnRenamed("source", "shard").repartition(4)
    got = linededup.dedup_lines(docs)
    assert found(got) == left_of(rows)
    assert got.columns[:5] == docs.columns


def test_empty(documents):
    assert linededup.dedup_lines(documents([])).count() == 0


def counted(index):
    return sorted((r.h1, r.h2, r.n_docs, r.last_doc) for r in index.counts.collect())


def test_a_load_in_batches_counts_as_one_insertion(documents):
    rows = corpus(5)
    one, many = (linededup.LineIndex.temporary(documents(rows).sparkSession) for _ in range(2))
    one.insert(documents(rows))
    many.load(documents(rows).repartition(3), batches=5)
    assert counted(many) == counted(one) and many.version == 6
    assert sorted(map(tuple, many.refs.select("h1", "h2", "doc_id").collect())) == sorted(
        map(tuple, one.refs.select("h1", "h2", "doc_id").collect())
    )
    with pytest.raises(ValueError):
        many.load(documents(rows))
    # What was loaded is changed like what was inserted.
    docs = documents([(d + 100, t) for d, t in corpus(6) if d is not None])
    for index in (one, many):
        index.insert(docs)
    assert counted(many) == counted(one)
    for index in (one, many):
        index.delete(docs.select("doc_id"))
    assert counted(many) == counted(one)


def test_the_filters_decide(documents, monkeypatch):
    """Without their answers every line of a later batch looks new, and shared lines are not found."""
    rows = corpus(7)
    assert found(linededup.dedup_lines(documents(rows))) == left_of(rows)
    empty = property(lambda self: self.spark.createDataFrame([], linededup.FILTERS))
    monkeypatch.setattr(linededup.LineIndex, "filters", empty)
    assert found(linededup.dedup_lines(documents(rows))) != left_of(rows)


def test_false_alarms_are_counted_and_join_the_filter(documents, spark):
    """A line that its filter may hold but the counts do not is new all the same."""
    index = linededup.LineIndex.temporary(spark)
    index.insert(documents([(1, LONG[0])]))
    (line,) = index.counts.collect()
    twin = (line.h1, line.h2 ^ 1)  # same shard, same fingerprint
    real, linededup.references = linededup.references, lambda *_: spark.createDataFrame([(*twin, 7)], "h1 long, h2 long, doc_id long")
    try:
        index.insert(documents([(7, "")]))
    finally:
        linededup.references = real
    assert counted(index) == sorted([(line.h1, line.h2, 1, 1), (*twin, 1, 7)])
    assert [r.lines for r in index.filters.collect() if r.lines] == [2]


def test_an_insertion_is_undone_by_deletion(documents, spark):
    first, later = corpus(3), [(d + 100, t) for d, t in corpus(4) if d is not None]
    index = linededup.LineIndex.temporary(spark)
    index.insert(documents(first))
    before = sorted(map(tuple, index.counts.collect()))
    assert {(r.h1, r.h2): r.last_doc for r in index.shared().collect()} and found(index.apply(documents(first))) == left_of(first)
    index.insert(documents(later))
    assert found(index.apply(documents(first + later))) == left_of(first + later)
    index.insert(documents(later))  # the same again changes nothing
    assert found(index.apply(documents(first + later))) == left_of(first + later)
    index.delete(spark.createDataFrame([(d,) for d, _ in later], "doc_id long"))
    assert sorted(map(tuple, index.counts.collect())) == before
    held = {r.shard: r for r in index.filters.collect()}
    for r in index.counts.collect():
        table = CuckooFilter.of_bytes(held[r.shard].slots)
        assert table.contains(np.array([r.h1]).view(np.uint64)).all()
    assert sum(r.lines for r in held.values()) == len(before)
    assert sum((np.frombuffer(r.slots, np.uint16) > 0).sum() for r in held.values()) == len(before)


@pytest.mark.parametrize("n", [1, 63, 5_000])
def test_filter(n):
    random.seed(n)
    digests = np.unique(np.array([random.getrandbits(64) for _ in range(2 * n)], np.uint64))
    random.shuffle(digests)
    table = CuckooFilter.sized(n)
    assert table.insert(digests[:n]) and table.contains(digests[:n]).all()
    assert table.contains(digests[n:]).sum() <= max(2, 0.01 * n)
    again = CuckooFilter.of_bytes(table.tobytes())
    again.delete(digests[: n // 2])
    assert again.contains(digests[n // 2 : n]).all() and (again.table > 0).sum() == n - n // 2


def test_a_filter_that_is_too_full_says_so():
    table = CuckooFilter(np.zeros((4, 4), np.uint16))
    assert not table.insert(np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_columns_of_the_same_names(documents):
    """Columns that the operator adds replace those of the input; names that it uses inside do not clash."""
    rows = [(i, "a line that is long enough to be dropped, all the same\nown") for i in range(6)]
    docs = documents(rows).withColumnsRenamed({"lang": "_drop", "source": "_of", "n_chars": "_kept"})
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_drop", "_of", "_kept", "_n_lines", "_n_dropped", "_kept_sha256"]
    assert sorted((r.doc_id, r._n_dropped, r._kept) for r in got.collect()) == [(i, 1, "own") for i in range(5)] + [(5, 0, rows[5][1])]


def test_tables_have_a_file_a_shard(documents, spark):
    """Not one for every partition of each shuffle that led to them."""
    rows = corpus(8)
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        index = linededup.LineIndex.temporary(spark)
        index.load(documents(rows))
        assert found(index.apply(documents(rows), whole=True)) == left_of(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("counts", "filters"):
        for version in range(2, index.version + 1):
            folder = f"{index.folder}/{name}-{version}".removeprefix("file:")
            assert len([f for f in os.listdir(folder) if f.startswith("part-")]) <= index.shards


def test_false_alarms_of_a_load(documents, spark, monkeypatch):
    """Lines that the filters only seem to hold are new: counts are right, and each is in its filter once."""
    rows = corpus(5)
    one, many = (linededup.LineIndex.temporary(spark) for _ in range(2))
    one.load(documents(rows))
    real = linededup._look_up
    monkeypatch.setattr(linededup, "_look_up", lambda *given: real(*given).withColumn("seen", F.lit(True)))
    many.load(documents(rows))
    assert counted(many) == counted(one)
    assert sum(r.lines for r in many.filters.collect()) == len(counted(one))
