"""Connected components of links between nodes: forests of parts of the links, then labels that spread and jump."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import cut

LINKS_AT_ONCE = 50_000  # links that a task makes one forest of


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a, b``): the root is the smallest node reachable.

    Links are read twice, so they should be at hand. So many at once become a forest first, in as many
    tasks as there are such parts; few links need no more than that. Links become parent pointers: in turn
    every node's larger neighbours are hung under its smallest neighbour, then its smaller ones. Both
    steps keep components as they are and shorten paths, so the number of rounds grows with the logarithm
    of the longest path. Each round is written to the shared folder; nothing is gathered on the driver but
    whether something changed. A node with many links is reduced to its smallest neighbour map-side first.
    """
    parts = links.count() // LINKS_AT_ONCE + 1
    pairs = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    edges = cut(_forests(pairs.coalesce(parts)))
    for _ in range(rounds):
        parents = edges.unionByName(edges.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node"))
        found = cut(parents.agg(F.min("v").alias("root"), F.max("v").alias("other")).coalesce(parts))
        # Done when every edge leads straight to a root: a root is its own parent, and nobody has two.
        if found.where("root <> other").isEmpty():
            return found.select("node", "root")
        edges = cut(_small_star(_large_star(edges)).coalesce(parts))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def _forests(pairs: DataFrame) -> DataFrame:
    """``u, v`` that connect what ``pairs`` do: of each part of them, the nodes and their smallest one."""

    def run(batches: Iterator[pa.RecordBatch]):
        kept, n = [], 0
        for batch in batches:
            kept.append([batch.column(k).to_numpy() for k in (0, 1)])
            n += batch.num_rows
            if n >= LINKS_AT_ONCE:
                yield _forest(*map(np.concatenate, zip(*kept, strict=True)))
                kept, n = [], 0
        if n:
            yield _forest(*map(np.concatenate, zip(*kept, strict=True)))

    return pairs.mapInArrow(run, "u long, v long")


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Every node and the smallest one it is connected with, but for those themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    smaller = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
