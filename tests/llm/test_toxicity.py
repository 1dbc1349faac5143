"""Held-out accuracy of the toxicity models, and what they do with odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = toxicity.score_texts(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    assert sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.015 * len(clean)


def test_labels_of_held_out_rows_change_nothing(tables, model, spark):
    docs, labels = tables
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = toxicity.train(docs.repartition(3), other)
    assert np.array_equal(again.full, model.full, equal_nan=True) and np.allclose(again.scale, model.scale)


def test_odd_rows(documents, model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "worthless idiot"), (4, "x" * 100_000), (4, "again"), (5, "***")]
    docs = documents(rows).withColumnsRenamed({"lang": "a", "source": "b"})
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id in (1, 2, 3)} == {0} and [r.held_out for r in got if r.doc_id is None] == [False]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_no_documents_or_labels(documents, spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for docs in (documents([]), documents([(1, "some text"), (2, "other")])):
        model = toxicity.train(docs, labels)
        assert toxicity.score_texts(docs, model).count() == docs.count()


def by_dictionary(rows):
    """Ratio of every n-gram and context of (text, toxic) rows, from plain dictionaries."""
    counts = defaultdict(Counter)
    for text, toxic in rows:
        for raw in set(toxicity.WORD.findall(text.lower())):
            word = raw.strip(toxicity.EDGES)
            s = toxicity.START + word + toxicity.END
            for i in range(1, len(s) if word else 0):
                counts[s[max(0, i - 6) : i + 1]][toxic] += 1
    kinds = Counter(g[-3:] for g in counts)
    last, before, types = Counter(t[-1] for t in kinds), Counter(), Counter()
    for tail, n in kinds.items():
        before[tail[:-1]] += n
        types[tail[:-1]] += 1
    every, off = defaultdict(Counter), defaultdict(Counter)
    for gram, n in counts.items():
        for k in (0, 1):
            every[gram[:-1]][k] += n[k]
            off[gram[:-1]][k] += min(n[k], toxicity.DISCOUNT)
    d, out = toxicity.SHARED_DISCOUNT, {}
    for context, n in every.items():
        fall = [off[context][k] / n[k] if n[k] else 1.0 for k in (0, 1)]
        out[context + toxicity.BLANK] = math.log(fall[1] / fall[0])
    for gram, n in counts.items():
        tail, of = gram[-3:], every[gram[:-1]]
        low = (kinds[tail] - d + d * types[tail[:-1]] * last[tail[-1]] / len(kinds)) / before[tail[:-1]]
        fall = [off[gram[:-1]][k] / of[k] if of[k] else 1.0 for k in (0, 1)]
        p = [(max(n[k] - toxicity.DISCOUNT, 0) / of[k] if of[k] else 0) + fall[k] * low for k in (0, 1)]
        out[gram] = math.log(p[1] / p[0])
    return out


def test_every_ngram_is_kept_and_none_answers_for_another(tables, model):
    docs, labels = tables
    known = by_dictionary([(r.text, r.toxic) for r in toxicity.training_rows(docs, labels).collect()])
    scorer = toxicity.Scorer((model.keys, model.full))
    grams = sorted(known)
    assert len(model.keys) == len(grams) and np.allclose(scorer.find(grams), [known[g] for g in grams], atol=1e-4)
    unseen = [g for g in (g[:-1] + c for g in grams[::50] for c in "qzx7") if g not in known]
    assert len(unseen) > 1_000 and np.isnan(scorer.find(unseen)).all()


def test_the_table_is_the_same_in_more_pieces(documents, spark, monkeypatch):
    docs = documents([(i, f"word{i} other{i % 7} again") for i in range(60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "ENTRIES_AT_ONCE", 50)
    pieces = toxicity.train(docs, labels)
    assert len(whole.keys) > 150 and (np.diff(whole.keys) > 0).all()
    assert all(np.array_equal(getattr(whole, k), getattr(pieces, k)) for k in ("keys", "full", "half"))


def test_a_long_word_is_looked_up_in_slices(model, monkeypatch):
    scorer = toxicity.Scorer((model.keys, model.full))
    words = ["idiot", "x" * 5_000, "...", "worthless"]
    whole = scorer.scores(words)
    monkeypatch.setattr(toxicity, "GRAMS_AT_ONCE", 7)
    assert np.allclose(scorer.scores(words), whole) and whole[2] == 0.0


@pytest.mark.parametrize("toxic", [0, 1, 2])
def test_a_handful_of_labels_drops_nothing(documents, spark, toxic):
    """Thirty documents of common words, thirteen with a label, one or none of them toxic."""
    words = "the market opened early and people bought bread milk apples fish cheese tea some more today".split()
    rows = [(i, " ".join(words[(i * k) % 16] for k in range(1, 25))) for i in range(30)]
    labels = [(i, int(i < toxic)) for i in range(13)]
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, toxicity.train(docs, marks)).count() == 30
    assert np.isfinite(toxicity.train(docs, marks).scale).all()


def test_the_pull_of_the_scale_is_smooth():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 19, 20, 21):
        assert toxicity.logistic(rng.normal(size=(n, 2)), np.zeros(n))[2] <= toxicity.KEEPING + 1e-9
    x = rng.normal(size=(4000, 2))
    y = (x @ [3.0, 1.0] - 2 > rng.logistic(size=4000)).astype(float)
    assert np.allclose(toxicity.logistic(x, y), (3.0, 1.0, -2.0), atol=0.3)
