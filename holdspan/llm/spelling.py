"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary's minimal acceptor is composed with a transducer that makes exactly one edit, and with the
acceptor again; what the composition accepts are the pairs of near words. Before its edit the transducer
copies, so it pays to let it start behind a copied half: words of equal length class that share their
first half are one *initial state*, and the edit lies behind it. Edits inside the first half leave the
second half as it is; they are found the same way on reversed words. Each pair is found exactly once.

Initial states are dealt out over tasks; a task reads its words in order and keeps one acceptor for a
bounded number of them. An initial state with very many words is cut into slices; each pair of slices is
composed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import cut, sql_ascii_lower

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 7
MIN_SEEN = 2
FORM_TIMES = 10  # how much more often than a word its form occurs
SLICE_WORDS = 20_000  # words of an initial state that are composed at once
STATES_KEPT = 200_000  # states of an acceptor before a task starts a new one
ROWS_AT_ONCE = 20_000


class Acceptor:
    """Minimal deterministic automata that share their states; a state is known by its right language."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.rests: dict[tuple[int, int], tuple[str, ...]] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return at

    def add(self, words: list[str]) -> int:
        """The state that accepts exactly ``words`` (sorted, distinct)."""
        finals, arcs, last = [False], [{}], ""
        for word in words:
            n = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                n += 1
            while len(finals) > n + 1:
                state = self._state(finals.pop(), arcs.pop())
                arcs[-1][last[len(arcs) - 1]] = state
            for _ in word[n:]:
                finals.append(False)
                arcs.append({})
            finals[-1] = True
            last = word
        while len(finals) > 1:
            state = self._state(finals.pop(), arcs.pop())
            arcs[-1][last[len(arcs) - 1]] = state
        return self._state(finals[0], arcs[0])

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """What both states accept."""
        key = (p, q) if p <= q else (q, p)
        found = self.rests.get(key)
        if found is None:
            out, waiting = [], [(p, q, "")]
            while waiting:
                a, b, done = waiting.pop()
                if self.final[a] and self.final[b]:
                    out.append(done)
                other = self.arcs[b]
                for c, to in self.arcs[a].items():
                    if c in other:
                        waiting.append((to, other[c], done + c))
            found = self.rests[key] = tuple(out)
        return found

    def replaced(self, p: int, q: int) -> Iterator[tuple[str, str]]:
        """Pairs accepted by p and q with one symbol replaced; with p = q each pair comes once."""
        waiting = [(p, q, "")]
        while waiting:
            a, b, done = waiting.pop()
            left, right = self.arcs[a], self.arcs[b]
            for c, to in left.items():
                for d, other in right.items():
                    if c == d:
                        waiting.append((to, other, done + c))
                    elif a != b or c < d:
                        for rest in self.common(to, other):
                            yield done + c + rest, done + d + rest

    def inserted(self, p: int, q: int) -> Iterator[tuple[str, str]]:
        """Pairs accepted by p and q where the second has one symbol more; the first place it can be in counts."""
        waiting = [(p, q, "")]
        while waiting:
            a, b, done = waiting.pop()
            left = self.arcs[a]
            for c, to in self.arcs[b].items():
                for rest in self.common(a, to):
                    if not rest.startswith(c):
                        yield done + rest, done + c + rest
                if c in left:
                    waiting.append((left[c], to, done + c))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters with A-Z in lower case, some misspelt on purpose, with their occurrences.

    Where 31 divides the CRC-32 of ``<id>:<run>``, the run loses one code point. Words have at least
    ``MIN_CHARS`` code points and ``MIN_SEEN`` occurrences. Null texts have no words; without an id
    nothing is deleted. Runs are counted a document before they are altered, words before the shuffle.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS[:-1]}{{{MIN_CHARS},}})"), F.lit(1))
    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(runs).alias("raw"))
    run = found.select("id", sql_ascii_lower(F.col("raw")).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.withColumn("crc", crc)
    at = (F.col("crc") % F.length("run")).cast("int")
    cut_out = F.concat(F.expr("left(run, cast(crc % length(run) as int))"), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("crc") % 31 == 0, cut_out).otherwise(F.col("run"))
    counted = run.select(word.alias("word")).where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_SEEN)


def _entries(vocabulary: DataFrame) -> DataFrame:
    """``way, size, half, rest, n``: each word at its initial states, from the front and from the back.

    ``size`` is the length of the shorter words of a class; a word is a shorter one of its own class and
    a longer one of the class below. ``rest`` is what lies behind the shared half, read away from it.
    """
    own = F.length("word")
    sizes = vocabulary.select("word", "n", F.explode(F.array(own, own - 1)).alias("size")).where("size > 0")
    front = F.floor(F.col("size") / 2).cast("int")
    back = (F.col("size") - front).cast("int")
    word, length = F.col("word"), F.length("word")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), word.substr(F.lit(1), front).alias("half"), word.substr(front + 1, length).alias("rest")),
        F.struct(
            F.lit(1).alias("way"),
            word.substr(length - back + 1, back).alias("half"),
            F.reverse(word.substr(F.lit(1), length - back)).alias("rest"),
        ),
    )
    return sizes.select("n", "size", F.explode(ways).alias("e")).select("e.way", "size", "e.half", "e.rest", "n")


GROUP = ["way", "size", "half"]


def _sliced(entries: DataFrame, most: int) -> DataFrame:
    """Adds ``low, high, slice``: a large initial state's words go to each pair of slices with their own."""
    sizes = entries.groupBy(*GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    sizes = sizes.select(*GROUP, F.ceil(F.col("_n") / most).cast("int").alias("_slices"))
    joined = entries.join(sizes, GROUP, "left")
    own = F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("rest"), F.col("_slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    paired = joined.withColumn("slice", own).withColumn("_other", other)
    return paired.select(
        *GROUP, F.least("slice", "_other").alias("low"), F.greatest("slice", "_other").alias("high"), "slice", "rest", "n"
    )


def _pairs(automaton: Acceptor, size: int, low: int, high: int, rows: list[tuple[int, str]], half: int):
    """(shorter or equal rest, longer or equal rest, longer) for the rows (slice, rest) of an initial state."""
    of: dict[tuple[int, bool], list[str]] = {}
    for part, rest in rows:
        of.setdefault((part, len(rest) + half > size), []).append(rest)
    at = {key: automaton.add(rests) for key, rests in of.items()}
    for p, q in ((low, high),) if low == high else ((low, high), (high, low)):
        if (p, False) not in at:
            continue
        if (q, False) in at and p <= q:
            for u, v in automaton.replaced(at[p, False], at[q, False]):
                yield u, v, False
        if (q, True) in at:
            for u, v in automaton.inserted(at[p, False], at[q, True]):
                yield u, v, True


NEAR = "word string, n_near long, best_n long, best string"


def near_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n_near, best_n, best`` for each word of an initial state that has near words there.

    Rows come in the order of initial states, slices and rests.
    """
    automaton, at, rows = Acceptor(), None, []
    out: list[tuple] = []

    def compose():
        way, size, half, low, high = at
        counts = {rest: n for _, rest, n in rows}
        full = (lambda rest: half + rest) if way == 0 else (lambda rest: rest[::-1] + half)
        found: dict[str, list] = {}
        for u, v, longer in _pairs(automaton, size, low, high, [r[:2] for r in rows], len(half)):
            # From the back, an edit that can as well lie behind the first half is one of the other way.
            if way == 1 and longer and v[1:] == u:
                continue
            for a, b in ((u, v), (v, u)):
                n, best = counts[b], found.get(a)
                if best is None:
                    found[a] = [1, n, b]
                else:
                    best[0] += 1
                    if n > best[1] or (n == best[1] and full(b) < full(best[2])):
                        best[1:] = n, b
        out.extend((full(a), k, n, full(b)) for a, (k, n, b) in found.items())

    def batch():
        columns = [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        out.clear()
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "best_n", "best"]
        )

    names = [*GROUP, "low", "high", "slice", "rest", "n"]
    for piece in batches:
        for *key, part, rest, n in zip(*(piece.column(piece.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if key != at:
                if len(rows) > 1:
                    compose()
                if len(automaton.final) > STATES_KEPT or len(automaton.rests) > STATES_KEPT:
                    automaton = Acceptor()
                if len(out) >= ROWS_AT_ONCE:
                    yield batch()
                at, rows = key, []
            rows.append((part, rest, n))
    if len(rows) > 1:
        compose()
    yield batch()


def neighbours(vocabulary: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``word, n, n_near, best_n, best`` of every word of ``word, n``: near words and the most frequent one."""
    rows = _sliced(_entries(vocabulary), slice_words)
    group = [*GROUP, "low", "high"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "slice", "rest")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("best_n", "long"), ("best", "string"))]
    found = ordered.mapInArrow(near_counts, NEAR).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best")
    every = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), *none).unionByName(found)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top"))
    return out.select("word", "n", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by jumping from form to form; a form occurs ten times as often, so chains are short."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        # Step over the ends of all links at once: a chain's length halves each round.
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(links.join(onward, "root", "left"))
        links = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.where("_next is not null").isEmpty():
            return links


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    Words are near if one code point inserted, deleted or replaced makes one the other. A word's form is
    its near word with most occurrences (of equal ones the first in code-point order), if it occurs at
    least ``FORM_TIMES`` times as often; the root is where following forms ends, or the word itself.

    Null and empty texts, and texts of short runs alone, add no words; a run may be as long as its text.
    Rows that repeat are counted each. An empty table gives no rows; extra columns are not read.
    """
    vocabulary = cut(words(docs, doc_id, text))
    often = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = cut(
        neighbours(vocabulary, slice_words).select(
            "word", F.when(often, F.col("best")).alias("form"), "n", "n_near", F.when(often, F.col("best_n")).alias("form_n")
        )
    )
    roots = _roots(found.where("form is not null"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
