"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

A source of weight w out of D gets w of every D slots. Its k-th block of a round (from 0) is released
at slot floor(k D / w) and due by slot ceil((k + 1) D / w). In every slot the released block with the
earliest deadline goes next. One round is one table of D rows, whatever the corpus; the schedule then
repeats, since after D slots every source has had exactly its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK_DOCS = 64  # documents of one source in a block
REST = "\x00rest"  # stands for every source without a weight of its own, and for none
CHUNK_DOCS = 20_000  # rows of a source that one task numbers, on average
DIGITS = 6  # hexadecimal digits of the digest that name a chunk: up to 16 M chunks a source


def one_round(spark: SparkSession, weights: dict[str, int], rest: int = 1) -> DataFrame:
    """``mix, weight, turn, release, deadline, slot`` of a round of ``sum(weights) + rest`` slots.

    Weights are whole numbers above zero, so a round is a bounded parameter. The schedule is one
    ``aggregate`` over the slots of a round.
    """
    given = {**weights, REST: rest}
    if any(w < 1 or int(w) != w for w in given.values()):
        raise ValueError("weights must be whole numbers above zero")
    names, length = sorted(given), sum(given.values())
    shares = [int(given[n]) for n in names]
    n = len(names)
    w = F.array(*map(F.lit, shares))

    def due(i: Column, k: Column) -> Column:
        return F.ceil((k + 1) * length / F.get(w, i)).cast("int")

    def released(i: Column, k: Column) -> Column:
        return F.floor(k * length / F.get(w, i)).cast("int")

    def pick(state: Column, slot: Column) -> Column:
        # The earliest deadline among released blocks; ties go to the first name.
        ready = F.filter(
            F.transform(
                state["done"],
                lambda k, i: F.struct(
                    due(i, k).alias("due"), i.alias("i"), released(i, k).alias("at"), k.alias("k")
                ),
            ),
            lambda x: (x["at"] <= slot) & (x["k"] < F.get(w, x["i"])),
        )
        best = F.array_min(ready)["i"]
        return F.struct(
            F.transform(state["done"], lambda k, i: F.when(i == best, k + 1).otherwise(k)).alias("done"),
            F.concat(state["order"], F.array(best)).alias("order"),
        )

    start = F.struct(
        F.array(*[F.lit(0)] * n).alias("done"), F.array().cast("array<int>").alias("order")
    )
    order = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), start, pick, lambda s: s["order"])
    slots = spark.range(1).select(F.posexplode(order).alias("slot", "i"))
    turn = F.row_number().over(W.partitionBy("i").orderBy("slot")) - 1
    label = F.get(F.array(*map(F.lit, names)), F.col("i"))
    return slots.withColumn("turn", turn).select(
        label.alias("mix"),
        F.get(w, F.col("i")).alias("weight"),
        "turn",
        released(F.col("i"), F.col("turn")).alias("release"),
        due(F.col("i"), F.col("turn")).alias("deadline"),
        "slot",
    )


def digest(doc_id: Column, tie: Column) -> Column:
    """The order of a source's documents: shuffled, and the same on every run and engine."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.hex(tie)))


def numbered(docs: DataFrame, by: dict[str, Column], n: int | None = None) -> DataFrame:
    """Rows with their number (``nth``, from 0) within ``mix`` in the order of ``key``.

    A source may hold most rows, so rows are numbered within chunks of the key's range, and the chunks'
    sizes are summed up; a chunk is a prefix of the digest, so both orders agree.
    """
    rows = docs.withColumns(by)
    n = rows.count() if n is None else n
    # Chunks are whole prefixes of the digest: 16 ** digits of them for each source.
    digits = next((d for d in range(1, DIGITS) if 16**d * CHUNK_DOCS >= n), DIGITS)
    rows = rows.withColumn("_chunk", F.substring("_key", 1, digits))
    sizes = rows.groupBy("_mix", "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_mix").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_mix", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_mix", "_chunk").orderBy("_key", "_tie"))
    rows = rows.withColumn("_inside", inside)
    return rows.join(sizes, ["_mix", "_chunk"]).withColumn("_nth", F.col("_before") + F.col("_inside") - 1)


def schedule(
    docs: DataFrame,
    weights: dict[str, int],
    rest: int = 1,
    block_docs: int = BLOCK_DOCS,
    source: str = "source",
    doc_id: str = "doc_id",
    n: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mixture.

    Added: ``_mix`` (the source, or the rest), ``_block`` (of the source, from 0), ``_slot`` (of the
    block), ``_release``, ``_deadline`` and ``_inside_block``. Up to the slot in which the first source
    runs dry, every source has had within one block of its share of slots; later its slots stay empty
    and the others go on in their proportions. No row is dropped or repeated.

    Null and unnamed sources share the weight ``rest``; rows with the same id, null among them, are all
    kept, in the order of their hash. Columns beginning with an underscore are reserved.
    """
    known = F.array(*map(F.lit, sorted(weights))) if weights else F.array().cast("array<string>")
    mix = F.when(F.array_contains(known, F.col(source)), F.col(source)).otherwise(F.lit(REST))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    by = {"_mix": mix, "_key": digest(F.col(doc_id), tie), "_tie": tie}
    rows = numbered(docs, by, n)
    plan = one_round(docs.sparkSession, weights, rest).select(
        F.col("mix").alias("_mix"),
        F.col("turn").cast("long").alias("_turn"),
        *[F.col(c).alias(f"_round_{c}") for c in ("slot", "release", "deadline")],
    )
    length = sum(weights.values()) + rest
    share = F.coalesce(*[F.when(F.col("_mix") == k, F.lit(v)) for k, v in {**weights, REST: rest}.items()])
    rows = rows.withColumn("_block", F.floor(F.col("_nth") / block_docs))
    rows = rows.withColumns({"_lap": F.floor(F.col("_block") / share), "_turn": F.col("_block") % share})
    # The round has as many rows as its parameters say.
    out = rows.join(F.broadcast(plan), ["_mix", "_turn"])
    lap = F.col("_lap") * length
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "_mix",
        "_block",
        (lap + F.col("_round_slot")).alias("_slot"),
        (lap + F.col("_round_release")).alias("_release"),
        (lap + F.col("_round_deadline")).alias("_deadline"),
        (F.col("_nth") % block_docs).alias("_inside_block"),
    )


def mix_sources(docs: DataFrame, weights: dict[str, int], rest: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture: files written from it follow each other.

    Rows are dealt out by ranges of slots and sorted within, so no task holds a source. Rows are as in
    ``schedule``; extra columns may have any name. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return schedule(rows, weights, rest, block_docs).orderBy("_slot", "_inside_block").select("row.*")
