"""The registered queries and the pipeline on small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from holdspan.llm import jaccard, linededup, mixing, toxicity
from holdspan.llm.queries import MIX_WEIGHTS, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def conn():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(spark, conn, key):
    ok, note = compare(spark, conn, SF, QUERIES[key], ORACLES[key])
    assert ok, note


def test_stages_follow_their_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_texts(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - toxic

    before, after = seen["line_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(linededup.line_key(line), set()).add(doc)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = {d: "\n".join(x for x in (t or "").split("\n") if shared.get(linededup.line_key(x), d) == d) for d, t in rows}
    assert {r.doc_id: r.text or "" for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)

    before, after = seen["ngram_jaccard_join"]
    sets = {r.doc_id: set(jaccard.shingles(r.text, 5).tolist()) for r in before.collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in after.collect()} == {d for d in ids if find(d) == d}

    before, after = seen["mixing_sources"]
    assert Counter(map(str, before.collect())) == Counter(map(str, after.collect()))

    before, after = seen["packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_sequences_follow_the_mixture(spark):
    """The first document of each sequence has a later place in the schedule than that of the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, SF).coalesce(1)
    place = {(r.doc_id): (r._slot, r._inside_block) for r in mixing.schedule(docs, MIX_WEIGHTS).collect()}
    pieces = corpus_pipeline.pack(spark, mixed.repartition(3, "doc_id"), SF).collect()
    first = {}
    for r in pieces:
        at = (*place[r.doc_id], r.start)
        first[r.sequence_id] = min(at, first.get(r.sequence_id, at))
    order = [first[k] for k in sorted(first)]
    assert len(order) > 20 and order == sorted(order)


CLASHING = ["_gone", "_drop", "_kept", "_n_dropped", "_slot", "_mix", "_key", "node", "root", "row", "h1", "component_id", "_of"]


@pytest.mark.parametrize("some", [True, False])
def test_stages_take_odd_rows_and_extra_columns(spark, some):
    """Null values in any column, empty and very long texts, repeated rows, no rows, and names used inside."""
    line = "one long line which many of the documents have among their lines"
    rows = [(i, f"{line}\nown words of number {i} " * 9, "en", f"src{i % 3}", 5) for i in range(9)]
    rows += [rows[0], rows[0], (1, None, None, None, None), (None, "no id", "en", "src0", 5), (None, None, None, None, None)]
    rows += [(20, "", "en", "", 0), (21, "long " * 30_000, "en", "src1", None), (22, "\n \n", None, "other", 4)]
    docs = spark.createDataFrame(rows if some else [], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        got = out.collect()
        if name in ("line_dedup", "mixing_sources"):
            assert len(got) == docs.count()
        assert some or not got


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "start"]


@pytest.mark.parametrize("stage, most", [("toxicity", 3_500), ("ngram_jaccard_join", 6_200)])
def test_small_tables_take_few_tasks(spark, stage, most):
    """The driver hears of every task, so a small table read often does not stay in a partition a shuffle has."""
    context = spark.sparkContext
    names = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    group = f"tasks of {stage}"
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    finally:
        context.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    said = context.statusTracker()
    stages = {i for job in said.getJobIdsForGroup(group) for i in said.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for i in stages if (info := said.getStageInfo(i)))
    assert 0 < tasks <= most, tasks
