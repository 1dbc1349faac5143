"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs.

Every paragraph is hashed to a wide vector and a document's fingerprint is the sum of them, each lane
modulo a power of two. Sums do not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector, without the rest of the text.

A vector has two parts. ``EXACT`` lanes modulo 2^64 follow from the paragraph's digest alone and tell
multisets apart. ``SKETCH`` lanes modulo 2^16 add up +1 or -1 for every word triple of the paragraph: the
squared length of the difference of two such sums estimates in how many triples the texts differ, within
about sqrt(2 / SKETCH) of all of them. Hashes are not keyed: fingerprints find equal and like texts, they
do not withstand someone who constructs collisions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import held, texts

EXACT = 16
SKETCH = 256
TRIPLE = 3
WORDS_KEPT = 250_000  # word hashes in a worker's cache: some 50 MB

U = np.uint64
_LANES = (np.arange(1, EXACT + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(1, -1)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, 1)
        return value


def paragraphs(text: str | None) -> list[str]:
    """Lines of the text, empty ones included; a null or empty text has none."""
    return text.split("\n") if text else []


def zero() -> np.ndarray:
    return np.zeros(EXACT + SKETCH, U)


def vector(parts: Iterable[str]) -> np.ndarray:
    """Sum of the paragraphs' vectors, lanes modulo 2^64."""
    out = zero()
    raw = [p.encode("utf-8", "surrogatepass") for p in parts]
    if not raw:
        return out
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), U).reshape(-1, 2)
    out[:EXACT] = _spread(_spread(digests[:, :1] + _LANES) ^ digests[:, 1:]).sum(axis=0, dtype=U)

    known = held("fingerprint words", _Words)
    if len(known) > WORDS_KEPT:
        known.clear()
    split = [p.split() for p in raw]
    sizes = np.array([len(w) for w in split])
    hashes = np.array([known[w] for words in split for w in words], U)
    triples = [np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 2) for w in split if 0 < len(w) < TRIPLE], U)]
    if len(hashes) >= TRIPLE:
        of = np.repeat(np.arange(len(sizes)), sizes)
        a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
        whole = of[:-2] == of[2:]
        triples.append(_spread(a * U(3) + _spread(b + _spread(c)))[whole])
    found = np.concatenate(triples)
    if len(found):
        sign = 1.0 - 2.0 * (found & U(1)).astype(np.float64)
        counts = np.bincount((found >> U(32)).astype(np.int64) % SKETCH, sign, SKETCH)
        out[EXACT:] = counts.astype(np.int64).view(U)
    return out


def written(v: np.ndarray) -> str:
    """A vector as text, each part modulo its power."""
    return base64.b64encode(v[:EXACT].astype("<u8").tobytes() + v[EXACT:].astype("<u2").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    """The vector again; sketch lanes are taken as the nearest to zero of those they can be."""
    raw = base64.b64decode(fingerprint)
    sketch = np.frombuffer(raw[8 * EXACT :], "<i2").astype(np.int64).view(U)
    return np.concatenate([np.frombuffer(raw[: 8 * EXACT], "<u8"), sketch])


def _small(lanes: np.ndarray) -> np.ndarray:
    return lanes.astype(np.uint16).view(np.int16).astype(np.float64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the estimated share of word triples that both have, twice counted (Dice)."""
    if np.array_equal(a[:EXACT], b[:EXACT]) and np.array_equal(a[EXACT:].astype(np.uint16), b[EXACT:].astype(np.uint16)):
        return 1.0
    x, y, apart = _small(a[EXACT:]), _small(b[EXACT:]), _small(a[EXACT:] - b[EXACT:])
    most = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(apart @ apart) / most)) if most else 0.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row, without a shuffle; a null or empty text has the empty sum."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            prints = [written(vector(paragraphs(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    rows = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def revised(prints: DataFrame, changes: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` after ``changes`` (``doc_id, paragraph, n``): n copies inserted, or deleted below 0.

    Changes are added up within each batch before they are shuffled, so a document of many changes meets
    its fingerprint as a few sums. Ids without a fingerprint start from the empty sum; null ids and null
    paragraphs or counts in ``changes`` take no part.
    """

    def sums(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for doc, part, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found[doc] = found.get(doc, zero()) + vector([part]) * U(n % 2**64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(map(written, found.values())), pa.string())], ["doc_id", "fingerprint"]
            )

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "fingerprint": [written(sum(map(read, group["fingerprint"]), zero()))]})

    given = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("paragraph"), F.col("n").cast("long").alias("n")).dropna()
    moved = given.mapInArrow(sums, "doc_id long, fingerprint string")
    same = prints.select("doc_id", "fingerprint")
    return same.unionByName(moved).groupBy("doc_id").applyInPandas(add, "doc_id long, fingerprint string")


def _place(of: Column, bounds: list[int]) -> Column:
    """How many of the rising ``bounds`` are not above a value: a binary search over one array."""
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]
    reached = lambda i, s: F.coalesce(F.get(known, i + s - 1) <= of, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(reached(i, s), i + s).otherwise(i))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``part, tail, doc_id, text``, to be read in this order: each row is followed by the next document.

    Ids are dealt out in ranges whose lower ends are ids of the table; the row at a range's start is also
    sent to the range before it, as its tail, and the first row of all to the last range. So each text is
    shuffled once, and as many more as there are ranges. Rows without an id get parts below 0, without
    tails.
    """
    rows = texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / n for k in range(1, n)] or [0.5]
    # One number for each range: quantiles are found by a sketch, and are ids that occur.
    low, found = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", cuts, max(10_000, 20 * n))).first()
    bounds = sorted({b for b in found or () if b > low})
    part = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(_place(F.col("doc_id"), bounds)).cast("int")
    placed = rows.withColumn("part", part)
    before = F.pmod(F.col("part") - 1, F.lit(len(bounds) + 1))
    own = F.struct(F.col("part"), F.lit(0).alias("tail"))
    first = F.col("doc_id").isin(low, *bounds) if low is not None else F.lit(False)
    places = F.when(first, F.array(own, F.struct(before.alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    sent = placed.select("doc_id", "text", F.explode(places).alias("at")).select("at.part", "at.tail", "doc_id", "text")
    return sent.repartition("part").sortWithinPartitions("part", "tail", "doc_id", "text")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited_end(text: str, other: str) -> tuple[str, np.ndarray]:
    """The text with its last quarter replaced by as much of ``other``'s beginning, and the change of its sum.

    Only paragraphs from the one that is cut are taken back and put in again.
    """
    n = len(text) // 4
    if not n:
        return text, zero()
    kept = len(text) - n
    start = text.rfind("\n", 0, kept) + 1
    edited = text[:kept] + other[:n]
    return edited, vector(edited[start:].split("\n")) - vector(text[start:].split("\n"))


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness; see ``COMPARED`` for the columns.

    The edited text ends in the beginning of the next document instead of its own last quarter; next is by
    rising id, rows repeated under one id by rising text, and the first one after the last. The edited
    fingerprint comes from the first one by deletion and insertion.

    A null text counts as empty. A row without an id stands in no order: its text is not edited and
    ``near_next`` is null. An empty table gives no rows; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        last = None  # (part, doc_id, text, vector) that waits for the next row
        for batch in batches:
            out: list[tuple] = []
            for part, tail, doc, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = own or ""
                v = vector(paragraphs(own))
                if last is not None and last[0] == part:
                    _, before, given, u = last
                    edited, change = edited_end(given, own)
                    out.append(_row(before, given, u, edited, u + change, v))
                last = None if tail or part < 0 else (part, doc, own, v)
                if part < 0:
                    out.append(_row(doc, own, v, own, v, None))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            names = [c.split()[0] for c in COMPARED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return with_next(docs, doc_id, text).mapInArrow(run, COMPARED)


def _row(doc, text: str, v: np.ndarray, edited: str, w: np.ndarray, following: np.ndarray | None) -> tuple:
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near_next = None if following is None else likeness(v, following)
    return doc, len(text), digest, written(v), written(w), likeness(v, w), near_next
