"""Exact search for the largest inner products, with a KD-tree in every shard of the vectors."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdspan.llm.common import cut

SHARD_ROWS = 16_384  # vectors of a tree: a few MB
LEAF_ROWS = 128
BLOCK_ROWS = 256  # queries that visit a tree together
EXACT = 2.0**53  # below it sums of whole numbers are exact as doubles
LARGEST = 2**63 - 1


def _floor(y):
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def whole(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``, doubles; vectors with a component that is no number are left out.

    Rows repeated under one id count once, as the smallest vector; a null id takes no part.
    """
    x = F.col(embedding)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    # From 2^53 on a double is whole as it is, and may be beyond a long.
    v = F.transform(x, lambda e: _floor(e.cast("double") * scale))
    rows = vectors.where(x.isNotNull() & F.col(vec_id).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


class KDTree:
    """Median splits on the widest side, down to small leaves; every node keeps its tight box."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.span = [], [], [], []
        self._build(points, order, 0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points, order, start: int, end: int) -> int:
        own = points[order[start:end]]
        node = len(self.low)
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.span.append((start, end))
        if end - start > LEAF_ROWS and (high > low).any():
            side = own[:, np.argmax(high - low)]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(side, half)]
            left = self._build(points, order, start, start + half)
            self.children[node] = (left, self._build(points, order, start + half, end))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query the largest inner product that each node's box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The ``k`` best (score, id), best first, of those that reach ``least``; the query's own id left out.

        Nodes are opened in the order of their bounds. The k-th score so far, or ``least`` from other
        shards, ends the search as soon as no box left can reach it; a box that can only equal it is
        opened, since a smaller id may win the tie.
        """
        found: list[tuple[float, int]] = []  # heap of (score, -id): the worst first
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(waiting, (-bounds[child], child))
                continue
            start, end = self.span[node]
            scores = self.points[start:end] @ query
            for at in np.flatnonzero(scores >= least).tolist():
                other = int(self.ids[start + at])
                if other == own:
                    continue
                item = (float(scores[at]), -other)
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
            if len(found) == k:
                least = max(least, found[0][0])
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _exact(ids: np.ndarray, points: np.ndarray, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same for components too large for doubles, in Python's whole numbers."""
    q = [int(x) for x in query]
    scored = ((sum(int(a) * b for a, b in zip(p, q, strict=True)), -int(i)) for i, p in zip(ids, points, strict=True) if i != own)
    return [(s, -i) for s, i in heapq.nlargest(k, scored)]


def trees(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, width, tree``: one serialised tree for each shard and vector length."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group["v"].tolist(), np.float64).reshape(len(group), -1)
        tree = KDTree(group["id"].to_numpy(), points)
        return pd.DataFrame({"shard": [key[0]], "width": [key[1]], "tree": [pickle.dumps(tree)]})

    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("width"), "id", "v")
    return placed.groupBy("shard", "width").applyInPandas(build, "shard int, width int, tree binary")


def query_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``block, width, queries``: queries in blocks of bounded size."""

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        points = np.array(group["v"].tolist(), np.float64).reshape(len(group), -1)
        return pd.DataFrame({"block": [key[0]], "width": [key[1]], "queries": [pickle.dumps((group["id"].to_numpy(), points))]})

    placed = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("width"), "id", "v")
    return placed.groupBy("block", "width").applyInPandas(gather, "block int, width int, queries binary")


def _visit(k: int):
    """Blocks of queries visit trees; a block's k-th scores go on to the next tree of the same task."""

    def run(batches: Iterator[pa.RecordBatch]):
        at, ids, points, least = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, width, raw, stored = (batch.column(i)[row].as_py() for i in range(4))
                if at != (block, width):
                    at = (block, width)
                    ids, points = pickle.loads(raw)
                    least = np.full(len(ids), -np.inf)
                tree = pickle.loads(stored)
                out: list[tuple] = []
                top = np.abs(points).max(initial=0) * max(np.abs(tree.low).max(initial=0), np.abs(tree.high).max(initial=0))
                small = top * max(1, width) < EXACT
                bounds = tree.bounds(points) if small else None
                for q, own in enumerate(ids.tolist()):
                    if small:
                        best = tree.search(own, points[q], bounds[q], k, least[q])
                        if len(best) == k:
                            least[q] = max(least[q], best[-1][0])
                    else:
                        best = _exact(tree.ids, tree.points, own, points[q], k)
                    out += [(own, i, max(-LARGEST, min(LARGEST, int(s)))) for s, i in best]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` largest inner products, ties to the smaller id.

    Components are taken as ``floor(scale * x)``, scores are whole numbers and exact (one beyond a long is
    given as the nearest). ``queries`` are rows of the same columns, all vectors by default; a query is not
    its own result, and is compared with vectors of its own length. Vectors that are null or hold a null, a
    NaN or an infinity take no part; an id that repeats counts once, as its smallest vector.

    Trees hold ``SHARD_ROWS`` vectors and blocks ``BLOCK_ROWS`` queries, so that tasks stay small; each
    block meets each tree once, and a query leaves a tree as soon as no box can improve it.
    """
    rows = whole(vectors, scale, vec_id, embedding)
    asked = rows if queries is None else whole(queries, scale, vec_id, embedding)
    shards = -(-max(1, vectors.count()) // SHARD_ROWS)
    blocks = -(-max(1, (vectors if queries is None else queries).count()) // BLOCK_ROWS)
    forest = cut(trees(rows, shards))
    asking = query_blocks(asked, blocks)
    # Every block is sent to every shard: rows of this join are blocks times trees, not queries times vectors.
    sent = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = sent.join(forest.hint("shuffle_hash"), ["shard", "width"])
    met = met.select("block", "width", "queries", "tree").repartition("block").sortWithinPartitions("block", "width")
    found = met.mapInArrow(_visit(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
