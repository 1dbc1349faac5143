"""Exact search against all products."""

import math
import random

import numpy as np
import pytest

from holdspan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def best(rows, k, every):
    kept = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(whole, kept.get(i, whole))
    out = []
    for q, a in kept.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in kept.items() if i != q and len(b) == len(a))
            out += [(q, r, i, max(-topk.LARGEST, min(topk.LARGEST, -s))) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed, n, width):
    random.seed(seed)
    centres = [[random.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + random.gauss(0, 0.3) for c in random.choice(centres)], 1) for i in range(n)]
    return rows + [(n + i, list(rows[7][1]), 2) for i in range(40)]  # copies tie


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 2), (3, 30)])
def test_top_k(spark, monkeypatch, seed, width):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rows = vectors(seed, 600, width)
    rows += [(10_000, None, 0), (None, rows[0][1], 0), (10_050, [None] * width, 0), (10_100, [float("nan")] * width, 0)]
    rows += [(10_150, [float("inf")] + [0.0] * (width - 1), 0), (10_200, [1.0], 0), (10_250, [2.0], 0), (10_300, [], 0)]
    rows += [(0, rows[1][1], 5), (0, rows[1][1], 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "shard").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=5)
    assert sorted(map(tuple, got.collect())) == best(rows, 5, 50)


def test_large_components(spark):
    rows = [(i, [random.uniform(-1, 1) * 10.0 ** random.randint(0, 30) for _ in range(4)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=3)
    want = best(rows, 3, 10)
    found = sorted(map(tuple, got.collect()))
    assert [(a, b, d) for a, b, _, d in found] == [(a, b, d) for a, b, _, d in want]


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (50, [2.0, 1.0], 0)], SCHEMA)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df).collect()) == [(0, 1, 50), (50, 1, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_boxes_end_the_search():
    random.seed(4)
    points = np.floor(np.array([r[1] for r in vectors(9, 4_000, 3)]) * 256)
    tree = topk.KDTree(np.arange(len(points)), points)
    for (start, end), low, high in zip(tree.span, tree.low, tree.high, strict=True):
        assert (tree.points[start:end].min(axis=0) == low).all() and (tree.points[start:end].max(axis=0) == high).all()
    opened = []
    tree.points = _Watched(tree.points, opened)
    query = points[0]
    found = tree.search(0, query, tree.bounds(query[None])[0], 5, -np.inf)
    scores = sorted(((s, -i) for i, s in enumerate(points @ query) if i), reverse=True)[:5]
    assert found == [(s, -i) for s, i in scores]
    assert sum(opened) < len(points) / 2


class _Watched:
    def __init__(self, points, opened):
        self.points, self.opened = points, opened

    def __getitem__(self, rows):
        self.opened.append(rows.stop - rows.start)
        return self.points[rows]
