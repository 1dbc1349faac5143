"""The schedule of a round and of a table."""

import random
from collections import Counter, defaultdict

import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2}, {"a": 7, "b": 5, "c": 11, "d": 1}, {f"s{k}": 1 + k % 4 for k in range(20)}])
def test_a_round_keeps_every_source_within_a_block(spark, weights):
    rows = mixing.one_round(spark, weights, rest=1).orderBy("slot").collect()
    given = {**weights, mixing.REST: 1}
    length = sum(given.values())
    assert [r.slot for r in rows] == list(range(length)) and Counter(r.mix for r in rows) == given
    had = Counter()
    for r in rows:
        assert r.release <= r.slot < r.deadline and r.turn == had[r.mix]
        had[r.mix] += 1
        for name, w in given.items():
            assert abs(had[name] * length - w * (r.slot + 1)) < length


def test_a_table(documents):
    random.seed(1)
    sources = ["big"] * 900 + ["a"] * 300 + ["b"] * 200 + ["other"] * 20
    rows = [(i, f"t{i}", s) for i, s in enumerate(sources)]
    rows += [(None, None, None), (None, "x", None), (3, "again", "big"), (3, "again", "big"), (5_000, "y" * 30_000, "a")]
    random.shuffle(rows)
    docs = documents(rows).withColumnRenamed("lang", "slot").withColumnRenamed("n_chars", "weight").repartition(6)
    got = mixing.schedule(docs, {"big": 3, "a": 2, "b": 1}, rest=1, block_docs=10).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.source)) for r in got) == sorted((str(a), str(b), str(c)) for a, b, c in rows)
    blocks = defaultdict(list)
    for r in got:
        blocks[r._mix, r._block, r._slot].append(r._inside_block)
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())
    slots = {k[2]: k[0] for k in blocks}
    assert len(slots) == len(blocks)  # a slot holds one block
    # Until the first source runs dry every slot is taken and no source is a block off its share.
    last = {m: max(s for s, x in slots.items() if x == m) for m in set(slots.values())}
    had = Counter()
    for slot in range(min(last.values()) + 1):
        had[slots[slot]] += 1
        for name, w in {"big": 3, "a": 2, "b": 1, mixing.REST: 1}.items():
            assert abs(had[name] * 7 - w * (slot + 1)) < 7


def test_order_and_plan(documents, spark):
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(400)]
    docs = documents(rows)
    mixed = mixing.mix_sources(docs, {"s0": 2, "s1": 1}, block_docs=5)
    got = [r.source for r in mixed.collect()]
    assert mixed.columns == docs.columns and len(got) == 400
    assert [len(set(got[i : i + 5])) for i in range(0, 200, 5)] == [1] * 40
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert mixing.mix_sources(documents([]), {"s0": 2}).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0}, {"a": 1.5}])
def test_weights_are_checked(spark, weights):
    with pytest.raises(ValueError):
        mixing.one_round(spark, weights)
