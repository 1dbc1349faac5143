"""A Merkle manifest of a table: one digest for all rows, a short proof for each of them.

Rows are leaves; in every group they stand in order, and each ``FANOUT`` consecutive nodes become one
parent. A level is a slot pivot: conditional aggregates spread the children of a parent into as many
columns as there are slots. All columns in turn are what the parent hashes; the columns without the own
one are a child's siblings. The roots of the groups are the leaves of one more tree.

Positions come from a sort over ranges, so a group that holds a third of all rows is many ranges, and no
node ever has more than ``FANOUT`` children. Proofs go down from the roots by joins on parents; what they
hold above the lowest level is written once for each lowest parent, not for each row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdspan.llm.common import cut

FANOUT = 16
PART = 33  # bits of a row's number inside its partition, in Spark's increasing ids


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def stated(c: Column) -> Column:
    """A value that cannot run into its neighbour: its length in bytes, a colon, itself; ``-`` for null."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row's values."""
    return digest(*[stated(c) for c in columns])


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` written in ranges of ``order`` (nulls first), with ``_at``: rising, but with gaps between ranges.

    Rows that are equal in ``order`` may stand either way round; they are split between ranges too.
    """
    given = rows.withColumn("_tie", F.monotonically_increasing_id())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in (*order, "_tie")]
    ranged = given.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def numbered(ordered: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """``group, no, n`` of every group in order, and the ordered rows with ``no``, ``n`` and ``pos``.

    ``no`` and ``pos`` count from 0.

    A range adds what lies before it, of the group and in all; only (group, range) pairs go through windows.
    """
    part = F.shiftright("_at", PART)
    ranges = cut(ordered.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n")))
    before = W.partitionBy(group).orderBy("_part")
    placed = ranges.withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    first = cut(ranges.groupBy(group).agg(F.min("_low").alias("_start"), F.sum("_n").alias("n")))
    groups = in_order(first, ["_start"])
    # Groups are as many as sources; they are numbered by the sizes of their ranges, one row a range.
    sizes = groups.groupBy(part.alias("_part")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    groups = groups.withColumn("_part", part).join(sizes, "_part")
    groups = cut(groups.select(group, (F.col("_at") - F.col("_low") + F.col("_before")).alias("no"), "n"))
    placed = placed.join(groups.select(F.col(group).alias("_g"), "no", "n"), F.col(group).eqNullSafe(F.col("_g")))
    placed = placed.select(F.col("_g"), F.col("_part").alias("_p"), "_low", "_before", "no", "n")
    rows = ordered.withColumn("_part", part).join(placed, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("pos", F.col("_at") - F.col("_low") + F.col("_before"))
    return groups, rows.drop("_g", "_p", "_part", "_low", "_before", "_at")


def _slots(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``no, parent, more`` and for every slot ``h0..`` and the carried columns ``<name>0..``."""
    slot = F.col("pos") % FANOUT
    of = [
        F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}")
        for c in ("h", *carried)
        for k in range(FANOUT)
    ]
    placed = nodes.withColumn("parent", F.floor(F.col("pos") / FANOUT))
    return placed.groupBy("no", "parent").agg(*of, F.max(F.col("n") > FANOUT).alias("more"), F.max("n").alias("n"))


def _own(k: int) -> Column:
    return F.col(f"h{k}")


def _joined(slots: Sequence[int]) -> Column:
    """The digests of the slots, left to right; a slot without a child adds nothing."""
    return F.concat_ws("", *[_own(k) for k in slots])


@dataclass(frozen=True)
class Tree:
    """Levels of runs from the leaves up, and ``no, top`` for every group."""

    levels: list[DataFrame]
    tops: DataFrame


def tree(nodes: DataFrame, carried: Sequence[str] = ()) -> Tree:
    """Trees over ``no, pos, n, h`` (group, position, nodes in the group, digest), one for each group.

    A group of one node is its own top. Each level is written: it is read once upwards and once down.
    """
    levels, tops = [], nodes.where("n = 1").select("no", F.col("h").alias("top"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = cut(_slots(nodes.where("n > 1"), carried))
        levels.append(runs)
        made = runs.select(
            "no",
            F.col("parent").alias("pos"),
            F.ceil(F.col("n") / FANOUT).alias("n"),
            digest(_joined(range(FANOUT))).alias("h"),
        )
        tops = tops.unionByName(made.where("n = 1").select("no", F.col("h").alias("top")))
        nodes, carried, most = made, (), -(-most // FANOUT)
    return Tree(levels, tops)


STEP = "array<struct<left:string,right:string>>"


def _children(runs: DataFrame, carried: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """A row for each child of each run: its position and what stands left and right of it."""
    each = [
        F.when(
            _own(k).isNotNull(),
            F.struct(
                F.lit(k).alias("slot"),
                _own(k).alias("h"),
                _joined(range(k)).alias("left"),
                _joined(range(k + 1, FANOUT)).alias("right"),
                *[F.col(f"{c}{k}").alias(c) for c in carried],
            ),
        )
        for k in range(FANOUT)
    ]
    rows = runs.select("no", "parent", *kept, F.explode(F.array_compact(F.array(*each))).alias("child"))
    return rows.select("no", (F.col("parent") * FANOUT + F.col("child.slot")).alias("pos"), *kept, "child")


def _runs_with_paths(built: Tree, above: DataFrame, kept: Sequence[str]) -> DataFrame | None:
    """The lowest runs with ``path``, the steps from their parent up, and the ``kept`` columns of ``above``."""
    below = None
    for runs in reversed(built.levels):
        whole = runs.where(~F.col("more")).join(above.select("no", *kept, "path"), "no")
        if below is not None:
            inner = below.withColumnRenamed("pos", "parent")
            whole = whole.unionByName(runs.where("more").join(inner, ["no", "parent"]))
        if runs is built.levels[0]:
            return whole
        step = F.array(F.struct("child.left", "child.right"))
        below = _children(whole, (), [*kept, "path"])
        below = below.select("no", "pos", *kept, F.concat(step, "path").alias("path"))
    return None


def proofs(
    rows: DataFrame, values: Sequence[str], group: str, order: str, changed: dict[str, Column] | None = None
) -> DataFrame:
    """``order, leaf, subroot, root, siblings_sha256, folded_root, verified`` of every row.

    A leaf is the digest of ``values``; leaves of a group ascend by ``order``, groups by ``group``, nulls
    first in both. ``changed`` gives altered values of columns (null: the row is as it was): each row's
    root is folded again from its altered leaf and its siblings, and is verified if that is the root.
    ``siblings_sha256`` is the digest of all siblings, from the lowest level up and left to right.

    Any value may be null; rows that repeat are leaves each; a table without rows gives none. Extra
    columns are not read, whatever their names.
    """
    columns = {c: rows[c] for c in values}
    altered = {c: F.coalesce((changed or {}).get(c, F.lit(None)).cast(rows.schema[c].dataType), columns[c]) for c in values}
    leaf = leaf_digest(list(columns.values()))
    other = leaf_digest(list(altered.values()))
    touched = F.lit(False)
    for c in (changed or {}).values():
        touched = touched | c.isNotNull()
    leaves = rows.select(
        columns[group].alias("_group"),
        columns[order].alias("id"),
        leaf.alias("h"),
        F.when(touched, other).alias("altered"),
    )
    _, placed = numbered(in_order(leaves, ["_group", "id", "h"]), "_group")
    nodes = placed.select("no", "n", "pos", "h", "id", "altered")
    low = tree(nodes, ("id", "altered"))
    subroots = cut(low.tops)
    n_groups = subroots.count()
    high = tree(subroots.select(F.col("no").alias("pos"), F.col("top").alias("h"), F.lit(n_groups).cast("long").alias("n"), (F.col("no") * 0).alias("no")))

    # Down again: what stands beside each group's root, then beside each run, then beside each leaf.
    start = high.tops.select("no", F.col("top").alias("root"), F.array().cast(STEP).alias("path"))
    if n_groups > 1:
        runs = _runs_with_paths(high, start, ["root"])
        found = _children(runs, (), ["root", "path"])
        above = found.select(
            F.col("pos").alias("no"), "root", F.concat(F.array(F.struct("child.left", "child.right")), "path").alias("path")
        )
    else:
        above = start
    above = cut(above.join(subroots.select("no", F.col("top").alias("subroot")), "no"))

    parts = []
    if low.levels:
        runs = _runs_with_paths(low, above, ["root", "subroot"])
        beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
        child = _children(runs.withColumn("beside", beside), ("id", "altered"), ["root", "subroot", "path", "beside"])
        parts.append(
            child.select(
                "child.id", F.col("child.h").alias("leaf"), "child.altered", "root", "subroot", "path",
                F.col("child.left").alias("left"), F.col("child.right").alias("right"), "beside",
            )
        )
    alone = nodes.where("n = 1").join(above, "no")
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    none = F.lit(None).cast("string")
    parts.append(
        alone.select("id", F.col("h").alias("leaf"), "altered", "root", "subroot", "path", none.alias("left"), none.alias("right"), beside.alias("beside"))
    )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = F.coalesce("altered", "leaf")
    lowest = F.when(F.col("left").isNull(), first).otherwise(digest(F.col("left"), first, F.col("right")))
    folded = F.aggregate("path", lowest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))
    out = out.select(
        "id",
        "leaf",
        "subroot",
        "root",
        digest(F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.col("beside")).alias("siblings_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", order)
