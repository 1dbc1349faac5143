"""Fingerprints against computing everything anew, and their likeness against counting triples."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import fingerprint as fp


def of(text):
    return fp.written(fp.vector(fp.paragraphs(text)))


def dice(a, b):
    def triples(text):
        out = Counter()
        for line in text.split("\n"):
            words = line.encode().split()
            k = min(3, len(words))
            out.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1) if words)
        return out

    x, y = triples(a), triples(b)
    # In squares of counts, as the sketch estimates it.
    most = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y[k] for k, v in x.items()) / most if most else 0.0


def prose(rng, lines, words=12):
    return "\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(0, words))) for _ in range(lines))


def test_sums():
    rng = random.Random(1)
    parts = prose(rng, 40).split("\n")
    shuffled = parts[:]
    rng.shuffle(shuffled)
    assert of("\n".join(parts)) == of("\n".join(shuffled))
    assert np.array_equal(fp.vector(parts[:9]) + fp.vector(parts[9:]), fp.vector(parts))
    assert np.array_equal(fp.vector(parts) - fp.vector(parts[:1]), fp.vector(parts[1:]))
    assert fp.written(fp.read(of("a b c d\ne"))) == of("a b c d\ne")
    different = ["", "a", "a\n", "\n", "\n\n", "a\na", "a b", "b a", "a b c", "a  b c", "A", "a\n\n", " a"]
    assert len({of(t) for t in different}) == len(different)
    assert of(None) == of("")


def test_likeness():
    rng = random.Random(2)
    errors = []
    for _ in range(200):
        a = prose(rng, rng.randint(1, 40))
        b = a[: len(a) * rng.randint(0, 4) // 4] + prose(rng, rng.randint(1, 20))
        got = fp.likeness(fp.vector(fp.paragraphs(a)), fp.vector(fp.paragraphs(b)))
        assert 0 <= got <= 1
        errors.append(abs(got - dice(a, b)))
    assert np.mean(errors) < 0.06 and max(errors) < 0.35
    assert fp.likeness(fp.zero(), fp.zero()) == 1.0
    assert fp.likeness(fp.vector(["a b c"]), fp.zero()) == 0.0
    # Counts far beyond a lane's modulus still give equal fingerprints for equal texts.
    assert of("a b c " * 90_000) == of("a b c " * 90_000)


def rows_of(seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-500, 5000), 150)
    rows = [(i, prose(rng, rng.choice([0, 1, 1, 3, 30]))) for i in ids]
    rows += [(6000, None), (6001, ""), (6002, "é"), (6003, "ab"), (6004, "Ω😀ab\n" * 5), (6005, "x" * 300_000), (6006, "w " * 50_000)]
    rows += [(ids[0], "again"), (ids[0], "again"), (ids[1], None), (None, "no id\nat all, 1 2 3 4"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4), (3, 40)])
def test_compare_edits(spark, documents, seed, parts):
    rows = rows_of(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        given = documents(rows).withColumnRenamed("lang", "part").withColumnRenamed("source", "tail").repartition(3)
        got = fp.compare_edits(given).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(((i, t or "") for i, t in rows if i is not None))
    want = []
    for at, (i, text) in enumerate(ordered):
        other = ordered[(at + 1) % len(ordered)][1]
        n = len(text) // 4
        want.append((i, text, text[: len(text) - n] + other[:n], other))
    want += [(None, t or "", t or "", None) for i, t in rows if i is None]
    expected = [
        (
            str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), of(text), of(edited),
            fp.likeness(fp.vector(fp.paragraphs(text)), fp.vector(fp.paragraphs(edited))),
            -1.0 if other is None else fp.likeness(fp.vector(fp.paragraphs(text)), fp.vector(fp.paragraphs(other))),
        )
        for i, text, edited, other in want
    ]
    found = [(str(r.doc_id), *r[1:6], -1.0 if r.near_next is None else r.near_next) for r in got]
    assert sorted(found) == sorted(expected)


def test_one_row_and_none(documents):
    assert fp.compare_edits(documents([])).collect() == []
    (row,) = fp.compare_edits(documents([(4, "abcdefgh")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    (row,) = fp.compare_edits(documents([(None, "abcdefgh")])).collect()
    assert row.near_edited == 1.0 and row.near_next is None


def test_revised(spark, documents):
    docs = documents([(1, "a b c d\ne f g\nh"), (2, ""), (3, None)])
    changes = [(1, "e f g", -1), (1, "new line", 2), (2, "x", 1), (9, "y", 1), (9, "z", 3), (9, "z", -3), (None, "q", 1), (1, None, 1)]
    got = fp.revised(fp.fingerprints(docs), spark.createDataFrame(changes, "doc_id long, paragraph string, n int").repartition(5))
    want = {1: of("new line\na b c d\nh\nnew line"), 2: of("x"), 3: of(""), 9: of("y")}
    assert {r.doc_id: r.fingerprint for r in got.collect()} == want
    assert fp.fingerprints(documents([])).count() == 0
