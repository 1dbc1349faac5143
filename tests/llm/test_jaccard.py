"""Similarity classes against all pairs, and components against a loop."""

import random

import pytest
from llmfixtures import documents  # noqa: F401

from holdspan.llm import components, jaccard
from holdspan.llm.components import connected


def classes(rows, width, percent):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = jaccard_words(text)
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i if rows[i][0] is not None else 0):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def jaccard_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def corpus(seed):
    """Bases with copies of every degree, passages that many share, odd texts."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdeÄé\x1c") for _ in range(random.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(random.choice([3, 5, 8, 20, 60, 150, 400]))]
        if random.random() < 0.4:
            base += passage
        for _ in range(random.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4, 9])):
                at = random.randrange(len(copy) + 1)
                copy[at : at + random.choice([0, 1])] = [word()] * random.choice([0, 1])
            rows.append(random.choice([" ", "\n", "\t "]).join(copy))
    rows += [None, "", "  \n", "a", "A", "one two", "One  two", "x" * 50_000, " ".join(map(str, range(30_000)))]
    rows.append(rows[-1] + " end")
    random.shuffle(rows)
    out = list(enumerate(rows, 7))
    return [*out, (7, "once more"), (7, "once more"), (None, rows[0])]


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60), (4, 4, 85)])
def test_classes(documents, seed, width, percent):
    rows = corpus(seed)
    got = jaccard.similarity_classes(documents(rows).withColumnRenamed("lang", "node").repartition(5), width, percent)
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())
    assert found == classes(rows, width, percent)


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80)])
def test_links(documents, monkeypatch, seed, width, percent):
    """Every link between different sets, from blocks and clusters of any number of slices."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    rows = corpus(seed)
    links, members = jaccard.similarity_links(documents(rows).repartition(5), width, percent)
    sets, least = {}, {}
    for doc, text in rows:
        words = jaccard_words(text)
        k = min(width, len(words))
        if words and doc is not None:
            found = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
            sets.setdefault(doc, []).append(found)
            least[found] = min(doc, least.get(found, doc))
    assert sorted((r.doc_id, r.set_id) for r in members.collect()) == sorted((d, least[s]) for d, x in sets.items() for s in x)
    names = list(least)
    want = set()
    for i, x in enumerate(names):
        for y in names[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                want.add((min(least[x], least[y]), max(least[x], least[y])))
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def near_copies(n, seed=7):
    """Copies of one text, each with other words in a few places: some pairs are similar, most nearly so."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = f"x{i}.{at}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("rows_at_once", [4_096, 40])
def test_a_hot_group_gives_few_rows(documents, monkeypatch, rows_at_once):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_at_once)
    monkeypatch.setattr(jaccard, "CLUSTER_ROWS", rows_at_once)
    counts = {}

    def counted(name):
        plain = getattr(jaccard, name)

        def run(*args, **more):
            out = jaccard.cut(plain(*args, **more))
            counts[name] = out.count()
            return out

        monkeypatch.setattr(jaccard, name, run)

    counted("near_links")
    counted("true_links")
    rows = near_copies(200)
    got = jaccard.similarity_classes(documents(rows), 4, 85)
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())
    assert found == classes(rows, 4, 85)
    pairs = (200 // rows_at_once + 1) ** 2
    assert counts.get("near_links", 0) < 200 * pairs and counts.get("true_links", 0) < 200 * pairs


def test_empty_table(documents):
    assert jaccard.similarity_classes(documents([])).count() == 0


def test_components(spark):
    random.seed(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(3, 3), (1, 160), (8, 9), (9, 8)]
    links += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(150)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((i, find(i)) for i in root)


@pytest.fixture
def many_partitions(spark):
    """Shuffles as wide as on a cluster, whatever they carry."""
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_links_are_few_tasks(spark, many_partitions):
    """Small tables in between are not spread over every partition of a shuffle, each with its files."""
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(50, "a")
    got = connected(links)
    assert got.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(301)]


def test_links_in_many_parts(spark, monkeypatch):
    """Forests of parts are joined by the rounds."""
    random.seed(9)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    table = spark.createDataFrame(links, "a long, b long").repartition(12)
    whole = sorted(map(tuple, connected(table).collect()))
    monkeypatch.setattr(components, "LINKS_AT_ONCE", 40)
    assert sorted(map(tuple, connected(table).collect())) == whole
    root, before = {n: n for a, b in links if a != b for n in (a, b)}, None
    while root != before:
        before = dict(root)
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert whole == sorted(root.items())
