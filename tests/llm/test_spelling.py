"""Spelling variants against comparing all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import spelling


def near(a, b):
    """Whether exactly one code point inserted, deleted or replaced makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    names = sorted(n)
    of = {w: [] for w in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if near(a, b):
                of[a].append(b)
                of[b].append(a)
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(of[w]), n[form[w]] if form[w] else -1) for w in names)


def corpus(seed):
    """Words of few letters with many neighbours, repeated letters, frequent forms with rare variants of variants."""
    rng = random.Random(seed)
    letters = "aabÀé÷"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(250)]
    stock += ["a" * k for k in range(6, 14)] + ["abcdefgh" * 40, "abcdefgh" * 39 + "abcdefg", "Éabcdefgh" * 9]
    chain = ["leading", "leadings", "leadingss", "leadingsss", "readingsss"]
    rows = []
    for i in range(400):
        some = rng.choices(stock, k=rng.randint(0, 30))
        if i % 3 == 0:
            some.append(rng.choice(stock).upper())
        rows.append(" 1".join(some))
    rows += [" ".join([w] * (2 * 11 ** (4 - k))) for k, w in enumerate(chain)]
    long = "x" * 5_000
    rows += [None, "", " \n", f"{long} {long}y", f"{long}. {long}y", "short all of it", "×" * 8 + " " + "×" * 8]
    out = list(enumerate(rows, -3))
    return [*out, (5, "again repeated repeated"), (5, "again repeated repeated"), (None, "nameless namelass namelass nameless")]


def found(documents, rows, **more):
    got = spelling.variant_groups(documents(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n").repartition(4), **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())


@pytest.mark.parametrize("seed,slice_words", [(1, 20_000), (2, 7), (3, 1)])
def test_variants(documents, seed, slice_words):
    rows = corpus(seed)
    want = expected(rows)
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)
    assert found(documents, rows, slice_words=slice_words) == want


def test_empty_table(documents):
    assert found(documents, []) == []
    assert found(documents, [(1, None), (2, "one two")]) == []


def test_the_acceptor_is_minimal():
    words = sorted(["tap", "taps", "top", "tops", "lap", "laps"])
    automaton = spelling.Acceptor()
    start = automaton.add(words)
    assert len(automaton.final) == 6  # t and l differ by "o"; all other endings are shared
    assert sorted(automaton.common(start, start)) == words
    assert sorted(automaton.replaced(start, start)) == [("lap", "tap"), ("laps", "taps"), ("tap", "top"), ("taps", "tops")]
    assert sorted(automaton.inserted(start, start)) == [("lap", "laps"), ("tap", "taps"), ("top", "tops")]


def test_a_large_initial_state_is_cut(spark):
    rows = spark.range(300).selectExpr("concat('abcdefgh', lpad(conv(id, 10, 26), 8, 'a')) as word", "id + 2 as n")
    sliced = spelling._sliced(spelling._entries(rows), 20)
    group = [*spelling.GROUP, "low", "high"]
    most = sliced.groupBy(*group).count().agg({"count": "max"}).first()[0]
    assert most < 100
    whole = {tuple(r) for r in spelling.neighbours(rows).collect()}
    assert whole == {tuple(r) for r in spelling.neighbours(rows, 20).collect()}
