"""Texts whose sets of word n-grams are similar, joined through parity sketches.

A set of hashed n-grams is spread over B blocks of bits; each n-gram flips one bit of its block. Two
sketches then differ in at most as many bits, and so in at most as many blocks, as the sets differ in
n-grams. Similar sets of s n-grams differ in at most t(s), so any t(s) + 1 blocks of a sketch hold one
that is the same in both. Sets are joined on such blocks within bands of sizes; whole sketches, then
whole sets decide.

Sets that are equal are one *node* from the start, so copies are never paired. A group of near copies
is not paired out either: every node is first tested against one centre. Components that still meet in
a block with near sketches then become clusters; inside a cluster each set is at hand once, sets that
are not together yet are compared in the task, and only links that join two components leave it. Blocks
and clusters above a size are cut into slices, and each pair of slices is a group of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import cut, cut_small, held, texts
from holdspan.llm.components import connected

SLICE = 256  # texts handled at once
WORDS_KEPT = 250_000  # word hashes in a worker's cache: some 50 MB
SPARE = 8  # one spare block for so many that are needed: a text then leaves its emptiest ones out
FEW = 100_000  # nodes a task remembers as already sent
MARKS = 1 << 25  # bits that mark wanted documents: 4 MB whatever the corpus
PAGE = 32_768  # bits of one bitmap of Spark's
BLOCK_ROWS = 4_096  # members of a block that a task compares with each other
CLUSTER_ROWS, CLUSTER_GRAMS = 1_024, 1 << 20  # nodes, and n-grams of all of them, that it verifies together

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, an empty one none.

    ``bytes.split`` and ``bytes.lower`` know ASCII white space and A-Z alone, which is what is wanted.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, U)
    known = held("word hashes", _Hashes)
    if len(known) > WORDS_KEPT:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    total = np.full(n, U(width))
    for k in range(width):
        total = total * U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(total))


@dataclass(frozen=True)
class Shape:
    """How sets of a size are sketched, for a similarity of ``percent``."""

    width: int
    percent: int

    def apart(self, sizes: int) -> int:
        """Most n-grams that two similar sets of together ``sizes`` are apart."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def bounds(self) -> list[float]:
        """Upper ends of the size bands; similar sets lie in the same band or in neighbours."""
        out, ratio = [], 100 / self.percent
        while not out or out[-1] < 2**40:
            out.append(ratio ** (len(out) + 1))
        return out

    def blocks(self, bounds: list[float], band: int) -> int:
        """Blocks of the sketches that are compared when the larger set lies in ``band``."""
        most = self.apart(2 * int(np.ceil(bounds[band]) - 1)) + 1
        return most + most // SPARE


def _flipped(flips: np.ndarray, hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive or of each block's flips, and how many n-grams the block has.

    The high bits of a hash choose the block; hashes are in order, and so are their blocks.
    """
    block = ((hashes >> U(32)) * U(blocks)) >> U(32)
    edges = np.searchsorted(block, np.arange(blocks + 1, dtype=U))
    out = np.bitwise_xor.reduceat(np.append(flips, U(0)), np.minimum(edges[:-1], len(hashes)))
    sizes = np.diff(edges)
    out[sizes == 0] = 0
    return out, sizes


def block_words(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A word for each block of 65,536 bits, and the block's n-grams.

    So many bits keep small blocks apart that hold other n-grams. A block is not written out: its word
    is the exclusive or of a number for each bit that is set, equal for equal blocks.
    """
    return _flipped(mix((hashes & U(0xFFFF)) + U(1)), hashes, blocks)


def sketch(hashes: np.ndarray, blocks: int) -> bytes:
    """The sketch with 16 bits a block, written out."""
    return _flipped(U(1) << (hashes & U(15)), hashes, blocks)[0].astype(np.uint16).tobytes()


def _node(hashes: np.ndarray) -> int:
    """A signed number that stands for a set; its last two bits are free."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()) & ~3)))


def _each_text(docs: DataFrame, make: Callable, schema: str, names: list[str]) -> DataFrame:
    """Apply ``make(ids, texts, state)``, which gives columns, to slices of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]):
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                columns = make(some.column(0).to_pylist(), some.column(1).to_pylist(), state)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def sets_of(docs: DataFrame, shape: Shape) -> DataFrame:
    """``doc_id, node, n``: the set of every text; no node for an empty one or a row without id."""

    def make(ids, texts, state):
        found = [shingles(t, shape.width) for t in texts]
        return [
            pa.array(ids, pa.int64()),
            pa.array([_node(h) if len(h) and i is not None else None for i, h in zip(ids, found, strict=True)], pa.int64()),
            pa.array([len(h) for h in found], pa.int64()),
        ]

    return _each_text(docs, make, "doc_id long, node long, n long", ["doc_id", "node", "n"])


def block_keys(docs: DataFrame, shape: Shape) -> DataFrame:
    """``key, ref`` for the blocks of every set: the node, plus 1 for a probe, plus 2 in the set's own window.

    A set in band k stands in the window of its own band, where it probes for sets that are not larger,
    and in the next one, where larger sets find it. It probes with the blocks that hold most n-grams.
    """
    bounds = shape.bounds()

    def make(ids, texts, state):
        sent = state.setdefault("sent", set())
        keys, refs = [], []
        for text in texts:
            h = shingles(text, shape.width)
            if not len(h):
                continue
            node = _node(h)
            if node in sent:
                continue
            if len(sent) >= FEW:
                sent.clear()
            sent.add(node)
            band = bisect_right(bounds, len(h))
            for window in (band, band + 1):
                blocks = shape.blocks(bounds, window)
                words, sizes = block_words(h, blocks)
                where = mix(np.arange(blocks, dtype=U) + (U(window) << U(32)))
                ref = np.full(blocks, node, np.int64)
                if window == band:
                    probes = np.argsort(-sizes, kind="stable")
                    ref[probes[: shape.apart(2 * len(h)) + 1]] += 1
                    ref += 2
                keys.append(mix(words ^ where).view(np.int64))
                refs.append(ref)
        empty = np.empty(0, np.int64)
        return [pa.array(np.concatenate(keys) if keys else empty), pa.array(np.concatenate(refs) if refs else empty)]

    return _each_text(docs, make, "key long, ref long", ["key", "ref"])


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Batches of rows sorted by the first column, cut so that no run of equal values is torn."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(new[0]):
            continue
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = np.searchsorted(rows[0], rows[0][-1], "left")
        held = [x[last:] for x in rows]
        if last:
            yield [x[:last] for x in rows]
    if held is not None:
        yield held


def shared_blocks(keys: DataFrame) -> DataFrame:
    """``key, node, probe, mine, centre`` of the blocks that several nodes have and one of them probes.

    Rows come sorted, so a task reads them as a stream; a key of very many nodes is the only thing it
    holds, as numbers. The centre of a block is its smallest node.
    """

    def run(batches):
        for key, ref in _runs(batches, ["key", "ref"]):
            node = ref & ~3
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(first)
            probe = np.maximum.reduceat(ref & 1, at)
            mine = np.maximum.reduceat(ref & 2, at) >> 1
            key, node = key[at], node[at]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(head)
            size = np.diff(np.append(starts, len(key)))
            good = (size > 1) & (np.maximum.reduceat(probe, starts) > 0)
            keep = np.repeat(good, size)
            centre = np.repeat(node[starts], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (key, node, probe, mine, centre)], ["key", "node", "probe", "mine", "centre"]
            )

    ordered = keys.repartition("key").sortWithinPartitions("key", "ref")
    return ordered.mapInArrow(run, "key long, node long, probe long, mine long, centre long")


def _sliced(rows: DataFrame, slices, *spread_by: str) -> DataFrame:
    """Adds ``low, high, slice``: rows of a group of several slices go to each pair of slices with their own."""
    own = F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    placed = rows.withColumn("slice", own).withColumn("_other", F.explode(F.sequence(F.lit(0), slices.cast("int") - 1)))
    return placed.withColumns({"low": F.least("slice", "_other"), "high": F.greatest("slice", "_other")}).drop("_other")


class _Labels:
    """Which rows of a group are together so far."""

    def __init__(self, roots: np.ndarray):
        self.of = np.unique(roots, return_inverse=True)[1]

    def merge(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def near_links(rows: DataFrame, shape: Shape, every: bool = False) -> DataFrame:
    """``u, v``, links of components that hold near sketches in a probed block, enough to span them.

    Rows come by block, or by pair of slices of one. A row is compared with those that are not together
    with it yet; each link found puts two components together, so a block gives fewer links than it
    has components, whatever the number of near pairs.
    """
    columns = ["key", "low", "high", "slice", "node", "probe", "n", "root", "sketch"]

    def run(batches):
        for held_rows in _runs(batches, columns):
            key, low, high, part, node, probe, n, root, written = held_rows
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.flatnonzero(new).tolist()
            us, vs = [], []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if b - a < 2 or root[a:b].min() == root[a:b].max() or not probe[a:b].any():
                    continue
                together = _Labels(root[a:b])
                raw = written[a:b]
                even = len({len(x) for x in raw}) == 1  # else equal keys of different windows, by chance: all are linked
                sketches = np.frombuffer(b"".join(raw), np.uint16).reshape(b - a, -1) if even else None
                for i in range(b - a - 1):
                    rest = slice(i + 1, b - a)
                    fit = together.of[rest] != together.of[i]
                    if low[a] != high[a]:
                        fit &= part[a:b][rest] != part[a + i]
                    if even:
                        fit &= (probe[a:b][rest] | probe[a + i]) > 0
                        fit &= 100 * np.minimum(n[a:b][rest], n[a + i]) >= shape.percent * np.maximum(n[a:b][rest], n[a + i])
                    at = np.flatnonzero(fit) + i + 1
                    if even and len(at):
                        bits = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
                        at = at[bits <= (100 - shape.percent) * (n[a + at] + n[a + i]) // (100 + shape.percent)]
                    for j in at.tolist():
                        if together.of[i] != together.of[j]:
                            if not every:
                                together.merge(i, j)
                            us.append(min(root[a + i], root[a + j]))
                            vs.append(max(root[a + i], root[a + j]))
            yield _pairs([np.array(us, np.int64)], [np.array(vs, np.int64)])

    group = ["key", "low", "high"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "node")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _open_blocks(members: DataFrame, roots: DataFrame, content: DataFrame) -> DataFrame:
    """Members of the blocks in which several components meet, with sizes and sketches; large blocks in slices."""
    placed = members.select("key", "node", "probe", "mine").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
    several = several.where("low <> high").select("key", F.ceil(F.col("rows") / BLOCK_ROWS).alias("slices"))
    joined = placed.join(several, "key").join(content.select("node", "n", "own", "next"), "node")
    # Of a set's two sketches the one for the block's window goes on.
    sketch = F.when(F.col("mine") == 1, F.col("own")).otherwise(F.col("next"))
    joined = joined.select("key", "node", "probe", "n", "root", "slices", sketch.alias("sketch"))
    return _sliced(joined, F.col("slices"), "node").drop("slices")


def near_clusters(links: DataFrame, roots: DataFrame, content: DataFrame) -> DataFrame:
    """``cluster`` and the content of all nodes of components that near sketches connect; large ones in slices."""
    of = connected(links.toDF("a", "b")).toDF("root", "cluster")
    placed = content.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).dropDuplicates(["node"])
    placed = cut(placed.join(of, "root"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    slices = F.ceil(F.greatest(F.col("rows") / CLUSTER_ROWS, F.col("grams") / CLUSTER_GRAMS))
    return _sliced(placed.join(sizes.select("cluster", slices.alias("slices")), "cluster"), F.col("slices"), "node").drop("slices")


def true_links(rows: DataFrame, shape: Shape) -> DataFrame:
    """``u, v`` of similar sets that join components inside a cluster: fewer than it has nodes.

    Each node's set is at hand once a cluster or pair of slices. Sketches sift the nodes that are not
    together with it yet, and sets decide: one n-gram after another is looked up among those of the node.
    """
    bounds = shape.bounds()
    columns = ["cluster", "low", "high", "slice", "node", "n", "root", "own", "next", "hashes"]

    def run(batches):
        for group in _groups(batches, columns, 3):
            low, high, part, node, n, root, own, following, hashes = group[1:]
            us, vs = [], []
            together = _Labels(root)
            bands = np.array([bisect_right(bounds, x) for x in n.tolist()])
            grams = np.concatenate([np.frombuffer(h, U) for h in hashes])
            dense = np.unique(grams, return_inverse=True)[1]
            ends = np.cumsum(n)
            seen = np.zeros(int(dense.max(initial=0)) + 1, bool)
            for i in np.argsort(-n, kind="stable").tolist():  # the larger one's window, with those that are not larger
                fit = (together.of != together.of[i]) & (n <= n[i]) & (100 * n >= shape.percent * n[i])
                if low[0] != high[0]:
                    fit &= part != part[i]
                at = np.flatnonzero(fit & (bands >= bands[i] - 1))
                if not len(at):
                    continue
                ours = np.frombuffer(own[i], np.uint16)
                other = np.frombuffer(b"".join([own[j] if bands[j] == bands[i] else following[j] for j in at]), np.uint16)
                bits = np.bitwise_count(other.reshape(len(at), -1) ^ ours).sum(axis=1, dtype=np.int64)
                near = bits <= (100 - shape.percent) * (n[at] + n[i]) // (100 + shape.percent)
                at = at[near][np.argsort(bits[near], kind="stable")]
                mine = dense[ends[i] - n[i] : ends[i]]
                seen[mine] = True
                for j in at.tolist():
                    if together.of[i] != together.of[j]:
                        both = int(np.count_nonzero(seen[dense[ends[j] - n[j] : ends[j]]]))
                        if 100 * both >= shape.percent * (n[i] + n[j] - both):
                            together.merge(i, j)
                            us.append(min(node[i], node[j]))
                            vs.append(max(node[i], node[j]))
                seen[mine] = False
            yield _pairs([np.array(us, np.int64)], [np.array(vs, np.int64)])

    group = ["cluster", "low", "high"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "node")
    return ordered.select(columns).mapInArrow(run, "u long, v long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int):
    """The columns of each run of rows that agree in the first ``keys`` ones."""
    kept: list[list] = []
    at = None

    def made():
        return [np.array(c, object if isinstance(c[0], bytes) else np.int64) for c in zip(*kept, strict=True)]

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            if row[:keys] != at:
                if len(kept) > 1:
                    yield made()
                at, kept[:] = row[:keys], []
            kept.append(row)
    if len(kept) > 1:
        yield made()


def _pairs(us: list, vs: list) -> pa.RecordBatch:
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(us) if us else empty), pa.array(np.concatenate(vs) if vs else empty)], ["u", "v"]
    )


def _places(doc_id) -> list:
    """Page and bit within it for the hash of an id."""
    place = F.pmod(F.xxhash64(doc_id), F.lit(MARKS))
    return [F.floor(place / PAGE).alias("page"), (place % PAGE).alias("bit")]


def _marks(doc_ids: DataFrame) -> np.ndarray:
    """A bit for each document, by the hash of its id; they are set in Spark and bounded by ``MARKS``."""
    pages = doc_ids.select(*_places("doc_id")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for row in pages.coalesce(8).toLocalIterator():
        at = row.page * PAGE // 8
        out[at : at + PAGE // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def marked(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ids are in ``doc_ids``, and a few others by chance; no text is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_marks(doc_ids))

    def run(batches):
        table = bits.value
        for batch in batches:
            at = batch.column(2).to_numpy() * PAGE + batch.column(3).to_numpy()
            good = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(good > 0)).select(["doc_id", "text"])

    return docs.select("doc_id", "text", *_places("doc_id")).mapInArrow(run, "doc_id long, text string")


def contents(docs: DataFrame, shape: Shape) -> DataFrame:
    """``node, n, hashes, own, next``: whole sets, and their sketches in both windows."""
    bounds = shape.bounds()

    def make(ids, texts, state):
        sent = state.setdefault("sent", set())
        found = []
        for h in (shingles(t, shape.width) for t in texts):
            if len(h) and _node(h) not in sent:
                if len(sent) >= FEW:
                    sent.clear()
                sent.add(_node(h))
                found.append(h)
        bands = [bisect_right(bounds, len(h)) for h in found]
        return [
            pa.array([_node(h) for h in found], pa.int64()),
            pa.array([len(h) for h in found], pa.int64()),
            pa.array([h.tobytes() for h in found], pa.binary()),
            pa.array([sketch(h, shape.blocks(bounds, k)) for h, k in zip(found, bands, strict=True)], pa.binary()),
            pa.array([sketch(h, shape.blocks(bounds, k + 1)) for h, k in zip(found, bands, strict=True)], pa.binary()),
        ]

    names = ["node", "n", "hashes", "own", "next"]
    return _each_text(docs, make, "node long, n long, hashes binary, own binary, next binary", names)


def _both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both nodes, as ``<column>_u`` and ``<column>_v``."""
    for side in ("u", "v"):
        named = of.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(named, side)
    return pairs


def _kept(pairs: DataFrame, test: Callable) -> DataFrame:
    """Rows ``u, v`` of ``pairs`` that pass ``test`` (a row as a dict of plain values)."""

    def run(batches):
        for batch in batches:
            parts = (batch.slice(at, SLICE).to_pylist() for at in range(0, batch.num_rows, SLICE))
            good = [bool(test(row)) for part in parts for row in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(pa.array(good, pa.bool_())) for c in "uv"], ["u", "v"]
            )

    return pairs.mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, content: DataFrame, shape: Shape) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar: first by whole sketches, then by whole sets."""
    bounds = shape.bounds()

    def near(row) -> bool:
        big, small = ("u", "v") if row["n_u"] >= row["n_v"] else ("v", "u")
        same = bisect_right(bounds, row["n_u"]) == bisect_right(bounds, row["n_v"])
        a, b = row[f"own_{big}"], row[f"own_{small}" if same else f"next_{small}"]
        if len(a) != len(b):  # more than one band apart
            return False
        bits = np.bitwise_count(np.frombuffer(a, np.uint16) ^ np.frombuffer(b, np.uint16))
        return int(bits.sum()) <= shape.apart(row["n_u"] + row["n_v"])

    def alike(row) -> bool:
        a, b = np.frombuffer(row["hashes_u"], U), np.frombuffer(row["hashes_v"], U)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= shape.percent * (len(a) + len(b) - both)

    close = _kept(_both(pairs, content, ["n", "own", "next"]), near)
    return _kept(_both(close, content, ["hashes"]), alike)


def _prepared(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set of each row, the shared blocks, and the content of every set that shares one."""
    sets = cut(sets_of(docs, shape))
    docs = docs.where("doc_id is not null")
    members = cut_small(shared_blocks(block_keys(docs, shape)))

    # One text stands for each set that shares a block with another one. A set may come from several
    # tasks; pairs then repeat, which changes nothing.
    nodes = members.select("node").distinct()
    named = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    chosen = cut(named.join(nodes, "node", "left_semi"))
    return sets, members, cut(contents(marked(docs, chosen.select("doc_id")), shape))


def similarity_links(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which documents have a set: ``a, b`` and ``doc_id, set_id``.

    A set is named by its smallest document; ``a < b`` are the names of similar sets, each pair once. The
    documents of one set all link with each other and with those of a linked set; they are not paired
    out. Texts, ids and odd rows are as in ``similarity_classes``; rows without a set are in neither
    table. Near sketches of a group become rows here, since each may be a link that is asked for.
    """
    shape = Shape(width, percent)
    docs = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, members, content = _prepared(docs, shape)
    content = cut(content.dropDuplicates(["node"]))
    apart = members.select("node", F.col("node").alias("root")).distinct()
    pairs = cut(near_links(_open_blocks(members, apart, content), shape, every=True))
    found = similar(pairs, content, shape)
    named = sets.where("node is not null and doc_id is not null")
    names = cut(named.groupBy("node").agg(F.min("doc_id").alias("set_id")))
    for side in ("u", "v"):
        found = found.join(names.select(F.col("node").alias(side), F.col("set_id").alias(f"of_{side}")), side)
    links = found.select(F.least("of_u", "of_v").alias("a"), F.greatest("of_u", "of_v").alias("b"))
    return links, named.join(names, "node").select("doc_id", "set_id")


def similarity_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Texts link when the sets of their ``width``-word n-grams have a Jaccard similarity of at least
    ``percent`` hundredths; a component is named by its smallest id. Words are split at ASCII white
    space, with A-Z in lower case; a text of fewer words is one n-gram.

    A null, empty or blank text has no set and is its own component. A row without id has no component
    and takes no part in links. Rows repeated under one id are judged each. An empty table gives no
    rows; extra columns are not read.

    Every link between different sets is either found or runs within a component that is already one.
    """
    shape = Shape(width, percent)
    docs = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, members, content = _prepared(docs, shape)

    # Each set against the centre with which it shares most blocks.
    votes = members.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    stars = votes.groupBy("node").agg(F.max(F.struct("n", "centre")).alias("best"))
    pairs = stars.select(F.col("node").alias("u"), F.col("best.centre").alias("v"))
    first = cut_small(similar(pairs, content, shape))
    roots = connected(first.toDF("a", "b"))

    # Then components that meet in a block with near sketches form clusters, in which sets decide.
    links = cut_small(near_links(_open_blocks(members, roots, content), shape))
    if not links.isEmpty():
        more = cut_small(true_links(near_clusters(links, roots, content), shape))
        if not more.isEmpty():
            roots = connected(first.unionByName(more).toDF("a", "b"))

    labelled = sets.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    smallest = labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(smallest, "class", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
