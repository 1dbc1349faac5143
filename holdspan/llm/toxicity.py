"""Toxicity by two Kneser-Ney models of the spelling of words, one of toxic and one of ordinary texts.

Each class has its own counts of a character after up to six characters of a word. What a class has
not seen often falls back to continuation counts that both classes share, so a rare expression is
judged by what sets its spelling apart, and not by which class happens to be larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdspan.llm.common import ROWS_A_TASK, WORD, cut, held, texts

ORDER = 7  # characters of the longest n-gram
DISCOUNT = 2.0  # taken from each count of a class: two sightings of an n-gram are no evidence
SHARED_DISCOUNT = 0.75
ENTRIES_AT_ONCE = 1 << 22  # entries of the score table that the driver fetches in one piece
GRAMS_AT_ONCE = 1 << 16  # n-grams looked up together
LABELS_AT_HAND = 500_000  # up to so many labels are sent to the tasks, beyond it both sides are shuffled
CALIBRATION_ROWS = 50_000  # bound of the labelled rows from which the score's scale is fitted
SHARE = 0.02  # of a toxic text's words that come from the toxic model
SCARCE = 100.0  # pull on the scale when one class has a single row
KEEPING = -2.5  # logit of a text about which nothing is known
MOST = 6.0  # nats that one word can add
EDGES = ".,;:!?\"'()[]{}*#$%&|<>"
START, END, BLANK = "\x02", "\x03", "\x04"
WORDS_KEPT = 200_000  # word scores in a worker's cache


@dataclass(frozen=True)
class Model:
    """Score tables, both in the order of the n-grams' sorted hashes, and the scale of the score."""

    keys: np.ndarray
    full: np.ndarray
    half: np.ndarray
    scale: tuple[float, float, float]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts (``id``, ``text``) with a usable label and a fold 0 or 1.

    A repeated label counts once, as toxic if any says so; null ids and labels are left out.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    given = texts(docs).select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    few = marks.limit(LABELS_AT_HAND + 1).count() <= LABELS_AT_HAND
    joined = given.join(F.broadcast(marks) if few else marks, "id")
    fold = F.floor(F.crc32(F.col("id").cast("string")) / 3) % 2
    return joined.select("id", "text", "toxic", fold.cast("int").alias("fold"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """Per n-gram the texts' words of each class and fold that hold it.

    Words are counted once a text and summed map-side before they are cut into n-grams.
    """
    split = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    words = rows.select("toxic", "fold", F.explode(F.array_distinct(split)).alias("raw"))
    words = words.select("toxic", "fold", F.btrim("raw", F.lit(EDGES)).alias("word")).where("word <> ''")
    sides = {f"{name}{fold}": (toxic, fold) for name, toxic in (("t", 1), ("o", 0)) for fold in (0, 1)}
    words = words.groupBy("word").agg(
        *[F.sum(F.expr(f"bigint(toxic = {x} and fold = {f})")).alias(k) for k, (x, f) in sides.items()]
    )
    spelled = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("s"), *sides)
    grams = F.transform(
        F.sequence(F.lit(2), F.length("s")),
        lambda i: F.substring(F.col("s"), F.greatest(F.lit(1), i - (ORDER - 1)), F.least(i, F.lit(ORDER))),
    )
    cut_up = spelled.select(F.explode(grams).alias("gram"), *sides)
    return cut_up.groupBy("gram").agg(*[F.sum(k).alias(k) for k in sides])


def backoff(counts: DataFrame, parts: int) -> DataFrame:
    """Shared probability of a character after two others: Kneser-Ney on kinds of longer n-grams."""
    tail = F.expr("right(gram, 3)")
    kinds = cut(counts.groupBy(tail.alias("tail")).agg(F.count("*").alias("n")).coalesce(parts))
    kinds = kinds.withColumns({"before": F.expr("left(tail, length(tail) - 1)"), "last": F.expr("right(tail, 1)")})
    ones = kinds.groupBy("last").agg(F.count("*").alias("kinds_of_last")).coalesce(parts)
    every = ones.agg(F.sum("kinds_of_last")).first()[0] or 1
    of = W.partitionBy("before")
    total, types = F.sum("n").over(of), F.count("*").over(of)
    d = SHARED_DISCOUNT
    return (
        kinds.join(ones, "last")
        .select(
            "tail",
            ((F.col("n") - d) / total + d * types / total * F.col("kinds_of_last") / F.lit(every)).alias("shared"),
        )
    )


def score_table(counts: DataFrame) -> DataFrame:
    """The log-likelihood ratios (all folds, fold 0 alone) of every n-gram, keyed by its 64-bit hash.

    A context has an entry too, for characters that neither class has seen after it: there the shared
    part cancels and only the classes' weights for falling back remain. It leaves with the context's
    first n-gram, so the counts, which should be at hand, are joined once. What shuffles leave is read by
    as many tasks as the counts fill.
    """
    parts = counts.count() // ROWS_A_TASK + 1
    counts = counts.coalesce(parts)
    shared = backoff(counts, parts)
    of = W.partitionBy("context")
    each = counts.withColumns(
        {
            "tail": F.expr("right(gram, 3)"),
            "context": F.expr("left(gram, length(gram) - 1)"),
            "t": F.col("t0") + F.col("t1"),
            "o": F.col("o0") + F.col("o1"),
        }
    )
    sums, rates = {"first": F.col("gram") == F.min("gram").over(of)}, {}
    for k in ("t", "o", "t0", "o0"):
        sums[f"all_{k}"] = F.sum(k).over(of)
        sums[f"off_{k}"] = F.sum(F.least(F.col(k), F.lit(DISCOUNT))).over(of)
    each = each.withColumns(sums).coalesce(parts).join(shared, "tail")
    for k in ("t", "o", "t0", "o0"):
        some = F.col(f"all_{k}") > 0
        rates[f"fall_{k}"] = F.when(some, F.col(f"off_{k}") / F.col(f"all_{k}")).otherwise(F.lit(1.0))
        own = F.when(some, F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"all_{k}")).otherwise(F.lit(0.0))
        rates[f"p_{k}"] = own + rates[f"fall_{k}"] * F.col("shared")
    each = each.withColumns(rates)

    def ratio(a: str, b: str) -> Column:
        return (F.log(F.col(a)) - F.log(F.col(b))).cast("float")

    def entry(key: Column, full: Column, half: Column) -> Column:
        return F.struct(F.xxhash64(key).alias("key"), full.alias("full"), half.alias("half"))

    gram = entry(F.col("gram"), ratio("p_t", "p_o"), ratio("p_t0", "p_o0"))
    context = entry(F.concat("context", F.lit(BLANK)), ratio("fall_t", "fall_o"), ratio("fall_t0", "fall_o0"))
    entries = F.when(F.col("first"), F.array(gram, context)).otherwise(F.array(gram))
    return each.select(F.explode(entries).alias("entry")).select("entry.*").coalesce(parts)


def fetched(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys, full, half`` of the whole table by rising key, fetched in pieces by the key's first bits."""
    n = table.count()
    keys, full, half = np.empty(n, np.int64), np.empty(n, np.float32), np.empty(n, np.float32)
    bits, start = max(1, (n // ENTRIES_AT_ONCE).bit_length()), 0
    for piece in range(-(1 << bits - 1), 1 << bits - 1):
        found = table.where(F.shiftright("key", 64 - bits) == piece).toArrow()
        key, end = found["key"].to_numpy(), start + found.num_rows
        order = np.argsort(key)
        keys[start:end] = key[order]
        full[start:end], half[start:end] = found["full"].to_numpy()[order], found["half"].to_numpy()[order]
        start = end
    return keys, full, half


class Scorer:
    """Scores words by a table and remembers them, within a bound."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.keys, self.ratios = table
        self.words: dict[str, float] = {}

    def find(self, grams: list[str]) -> np.ndarray:
        """The ratio of each n-gram, NaN for one that is not in the table."""
        digest = xxhash.xxh64_intdigest
        want = np.fromiter(map(digest, map(str.encode, grams), repeat(42)), np.uint64, len(grams)).view(np.int64)
        if not len(self.keys):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ratios[at].astype(np.float64), np.nan)

    def scores(self, raw: list[str]) -> list[float]:
        """Damped log-likelihood ratio of each word: a toxic text is ordinary but for a share of its words."""
        totals = np.zeros(len(raw))
        grams: list[str] = []
        of: list[int] = []
        sizes: list[int] = []

        def add_up():
            values = self.find(grams)
            lost = np.flatnonzero(np.isnan(values))  # no such n-gram
            values[lost] = self.find([grams[i][:-1] + BLANK for i in lost])
            np.add.at(totals, np.repeat(np.array(of, np.int64), sizes), np.nan_to_num(values))
            grams.clear()
            of.clear()
            sizes.clear()

        for k, w in enumerate(raw):
            spelled = w.lower().strip(EDGES)
            if not spelled:
                continue
            s = START + spelled + END
            for start in range(2, len(s) + 1, GRAMS_AT_ONCE):
                stop = min(len(s) + 1, start + GRAMS_AT_ONCE)
                grams.extend([s[e - ORDER if e > ORDER else 0 : e] for e in range(start, stop)])
                of.append(k)
                sizes.append(stop - start)
                if len(grams) >= GRAMS_AT_ONCE:
                    add_up()
        add_up()
        return np.minimum(MOST, np.log1p(SHARE * np.expm1(np.minimum(totals, 30.0)))).tolist()

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the words' scores by their number, and by its root."""
        raw = WORD.findall(text or "")
        if not raw:
            return 0.0, 0.0
        known = self.words
        values = list(map(known.get, raw))
        if None in values:
            new = list({w: None for w, v in zip(raw, values) if v is None})
            fresh = dict(zip(new, self.scores(new)))
            values = [fresh[w] if v is None else v for w, v in zip(raw, values)]
            if len(known) > WORDS_KEPT:
                known.clear()
            known.update((w, v) for w, v in fresh.items() if len(w) <= 100)
        total = sum(values)
        return total / len(raw), total / math.sqrt(len(raw))


def _scorer(shared: Broadcast, kind: str) -> Scorer:
    """One scorer a worker: its cache outlives a task."""
    table = shared.value
    return held(("scorer", kind, id(table)), lambda: Scorer(table))


def with_features(rows: DataFrame, shared: Broadcast, kind: str) -> DataFrame:
    """Adds the two features to rows of (..., text), without the text."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", a double, b double"
    names = [f.name for f in kept]

    def score(batches: Iterator[pa.RecordBatch]):
        scorer = _scorer(shared, kind)
        for batch in batches:
            pairs = [scorer.features(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names]
                + [pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)],
                [*names, "a", "b"],
            )

    return rows.mapInArrow(score, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method for two features and a constant, pulled towards a scale that keeps everything.

    The pull falls with the square of the rows in the smaller class: among a hundred it is nothing, of a
    few the weights of both features stay near 0 and the constant near ``KEEPING``, as without any rows.
    """
    fewer = max(1.0, min(y.sum(), len(y) - y.sum()))
    ridge += SCARCE / fewer**2
    spread = x.std(axis=0) if len(x) else np.ones(2)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = np.column_stack([x / spread, np.ones(len(x))])
    rest = np.array([0.0, 0.0, KEEPING])
    w = np.zeros(3)
    pull = np.full(3, ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + pull * (w - rest)
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * 4.0 / max(4.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread[0]), float(w[1] / spread[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts of all labelled rows outside the held-out third, and a scale fitted on one fold.

    The scale is fitted on texts of fold 1 with the model of fold 0, which has not seen them. The score
    table reaches the driver whole, with 16 bytes for every n-gram and context; the calibration is
    bounded by ``CALIBRATION_ROWS``.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    keys, full, half = fetched(cut(score_table(cut(gram_counts(rows)))))
    shared = spark.sparkContext.broadcast((keys, half))
    some = rows.where("fold = 1").select("id", "toxic", "text")
    some = with_features(some, shared, "half").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).toArrow()
    x = np.column_stack([some["a"].to_numpy(), some["b"].to_numpy()]).reshape(-1, 2)
    scale = logistic(x, some["toxic"].to_numpy().astype(float))
    shared.unpersist()
    return Model(keys, full, half, scale)


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, in one pass without a shuffle.

    A null or empty text has no words and gets the score of no evidence; a null id is kept and is not
    held out; repeated rows are scored each. Only ids and texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.full))
    wa, wb, w0 = model.scale
    rows = with_features(texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shared, "full")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") * wa + F.col("b") * wb + w0)))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.full))
    wa, wb, w0 = model.scale
    limit = math.log(threshold / (1 - threshold))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]):
        scorer = _scorer(shared, "full")
        for batch in batches:
            pairs = (scorer.features(t.as_py()) for t in batch.column(place))
            yield batch.filter(pa.array([a * wa + b * wb + w0 < limit for a, b in pairs], pa.bool_()))

    return texts(docs).mapInArrow(keep, docs.schema)
