"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import WHITE

SYMBOLS = "#*$%&|<>"

# Very common words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at by this have from or an not "
    "le la les de des du et en un une est que qui dans pour sur pas par au avec "
    "el los las y un una es en que del por con para se lo como su "
    "der die das und ist nicht ein eine zu von mit den dem im auf für sich"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is kept if ``low <= 100 * measure / base <= high``; a zero base passes."""

    name: str
    measure: str
    base: str
    low: float | None = None
    high: float | None = None


# Percentages, and so exact in whole numbers.
RULES = (
    Rule("word_length", "word_chars", "n_words", 250, 1_500),
    Rule("symbols", "n_symbols", "n_words", high=15),
    Rule("marks", "n_marks", "n_words", high=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
)


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sorted_windows(words: Column, n: Column, width: int = 3) -> Column:
    """Windows of ``width`` words with their places, equal ones side by side; null without any.

    Arrays are only named outside of lambdas, here and below: a filter that the optimizer moves down
    repeats these expressions, and must not do so for every word.
    """
    count = n.cast("int") - (width - 1)
    side_by_side = F.arrays_zip(*[F.slice(words, k + 1, count) for k in range(width)])
    windows = F.transform(
        side_by_side, lambda x, i: F.struct(F.concat_ws(" ", *[x[str(k)] for k in range(width)]).alias("w"), i.alias("i"))
    )
    return F.when(n >= width, F.sort_array(windows))


def covered_words(ordered: Column, width: int = 3) -> Column:
    """How many words lie in windows that occur twice or more.

    A repeated window equals a neighbour in sorted order, so a text of n words costs n log n.
    """
    size = F.size(ordered)
    same = F.zip_with(F.slice(ordered, 1, size - 1), F.slice(ordered, 2, size - 1), lambda a, b: a["w"] == b["w"])
    edge = F.array(F.lit(False))
    again = F.zip_with(F.concat(edge, same), F.concat(same, edge), lambda a, b: a | b)
    places = F.filter(F.zip_with(ordered, again, lambda x, y: F.when(y, x["i"])), lambda i: i.isNotNull())
    covered = F.flatten(F.transform(places, lambda i: F.array(*[i + k for k in range(width)])))
    return F.coalesce(F.when(size > 0, F.size(F.array_distinct(covered))).cast("long"), F.lit(0).cast("long"))


def judge(rules: tuple[Rule, ...]) -> Column:
    """The rule table as one boolean column over the measures."""

    def passes(rule: Rule) -> Column:
        share, base = F.col(rule.measure) * 100, F.col(rule.base)
        out = F.lit(True)
        if rule.low is not None:
            out = out & (share >= base * rule.low)
        if rule.high is not None:
            out = out & (share <= base * rule.high)
        return out

    return reduce(lambda a, b: a & b, map(passes, rules), F.lit(True))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole-number counts of every text, from which the rules are made.

    Built-in functions only, row by row: nothing is shuffled and no other column is read. A null text
    counts as empty and has zeros; a null id is kept; repeated rows are measured each.
    """

    def count(array: Column) -> Column:
        return F.size(array).cast("long")

    def chars(characters: str) -> Column:
        return (F.length("text") - F.length(F.translate("text", characters, ""))).cast("long")

    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = cut.withColumns({"words": words_of(F.col("text")), "lines": F.split("text", "\n")})
    cut = cut.withColumns(
        {
            "n_words": count(F.col("words")),
            "word_chars": F.length(F.translate("text", WHITE, "")).cast("long"),
            "n_symbols": chars(SYMBOLS),
            "n_marks": chars("!"),
            "n_lines": count(F.col("lines")),
            "worded": F.filter("lines", lambda x: F.length(F.translate(x, WHITE, "")) > 0),
        }
    )
    cut = cut.withColumns(
        {
            "windows": sorted_windows(F.col("words"), F.col("n_words")),
            "n_dup_lines": count(F.col("worded")) - count(F.array_distinct("worded")),
            "n_stop_words": count(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))),
        }
    )
    return cut.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered_words(F.col("windows")).alias("n_repeat_words"), "n_lines", "n_marks", "n_stop_words",
    )


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``base_failed`` (too short or too repetitive) and ``kept`` (that not, and every rule passed)."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & judge(rules))
