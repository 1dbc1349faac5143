"""Quality measures and url rules against loops."""

import random

import numpy as np
import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import quality, urlfilter
from holdspan.llm.common import WORD


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(three) if three.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_measures(documents):
    random.seed(2)
    parts = ["a", "b", "The", "the", " ", " ", "\n", "\n", "\t", "#", "é", "日本", "\x1c", "!", "|"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "\n\n", "a a a", "a a a a", "one two", "same\nsame\n same", "w " * 3_000, "z" * 60_000]
    rows = [*enumerate(texts), (None, "x"), (0, texts[0])]
    docs = documents(rows).withColumnsRenamed({"lang": "words", "source": "lines", "n_chars": "n_words"})
    got = quality.apply_rules(quality.measure(docs))
    want = sorted((str(d), *measured(t)) for d, t in rows)
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality.measure(documents([])).count() == 0


def test_rules_keep_prose_and_drop_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.apply_rules(quality.measure(docs)).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("NET", "/fr/", "block"), ("x.org", "", "block")]
URLS = [None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/a?b#c", "https://a.www.example.com/en/",
        "https://myexample.com/en/", "http://a.net/es/", "http://a.net/es", "http://net/fr/x", "http://y.x.org", "http://x.org?q=/",
        "x://a://b/c", "http://a.com#/en/", "http://.com/", "http://" + "a." * 3_000 + "com/", "http://ä.com/É",
        "http://x.org/" + "p" * 50_000]


def judged(url):
    host, path = urlfilter.split_url(url)
    best = None
    for rh, rp, verdict in RULES:
        rh = rh.lower()
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp) and (best is None or len(rh + rp) > len(best[0])):
            best = (rh + rp, verdict)
    return (host, path, *(best or (None, "allow")))


def test_split():
    assert urlfilter.split_url("HTTP://A.B:80/c/d?e#f") == ("a.b:80", "/c/d")
    assert urlfilter.split_url("x://a://b/c") == ("a:", "//b/c")
    assert urlfilter.split_url("http://h?x/y") == ("h", "") and urlfilter.split_url("//h/p") == ("", "")


def test_urls(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(URLS)] + [(None, URLS[5], None), (5, URLS[5], "rule")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = urlfilter.filter_urls(pages, RULES).collect()
    want = sorted((str(i), *map(str, judged(u))) for i, u, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    assert urlfilter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda key: len(key) % 3)
    table = urlfilter.RuleFile(urlfilter.write_rules(RULES, str(tmp_path)))
    assert len(np.unique(table.digests)) < len(RULES)
    split = [urlfilter.split_url(u) for u in URLS]
    found = [(m and m[0], "allow" if m is None or not m[1] else "block") for m in table.match(split)]
    assert found == [judged(u)[2:] for u in URLS]


@pytest.mark.parametrize("n", [0, 1])
def test_few_rules(tmp_path, n):
    table = urlfilter.RuleFile(urlfilter.write_rules(RULES[:n], str(tmp_path)))
    assert [m is not None for m in table.match([("a.com", "/"), ("a.net", "/")])] == [n == 1, False]
