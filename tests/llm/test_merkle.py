"""The manifest against trees built in a loop."""

import hashlib
import zlib

import pytest
from llmfixtures import documents  # noqa: F401
from pyspark.sql import functions as F

from holdspan.llm import merkle

VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row[c] for c in VALUES[:-1]] + [row.text if text is None else text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def expected(rows, altered):
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r.doc_id), leaf(r))):
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=first)
    trees = [levels([leaf(r) for r in groups[g]]) for g in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for at, (g, built) in enumerate(zip(names, trees, strict=True)):
        for pos, r in enumerate(groups[g]):
            fold, siblings = leaf(r, altered(r)), []
            for nodes, p in ((built, pos), (top, at)):
                for level in nodes[:-1]:
                    run = level[p // 16 * 16 : p // 16 * 16 + 16]
                    left, right = run[: p % 16], run[p % 16 + 1 :]
                    siblings += left + right
                    fold, p = digest(*left, fold, *right), p // 16
            out.append((str(r.doc_id), leaf(r), built[-1][0], top[-1][0], digest(*siblings), fold, fold == top[-1][0]))
    return sorted(out)


def check(rows):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower)}

    def altered(r):
        if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5:
            return r.text
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)

    names = ["doc_id", "leaf", "subroot", "root", "siblings_sha256", "folded_root", "verified"]
    got = merkle.proofs(rows, VALUES, "source", "doc_id", changed)
    assert got.columns == names
    found = sorted(tuple(str(v) if i == 0 else v for i, v in enumerate(r)) for r in got.collect())
    assert found == expected(rows.select(VALUES).collect(), altered)
    return found


@pytest.mark.parametrize("sources", [1, 3, 19, 40])
def test_trees(documents, sources):
    """Groups of one leaf, of full runs, of one leaf more, and one that holds half of all rows."""
    rows = [(i * 7 % 601, f"Text {i} É\n", f"s{i % sources}" if i % 2 else "hot") for i in range(600)]
    rows += [(1000 + i, "X" * i, "sixteen") for i in range(16)] + [(2000 + i, None, "seventeen") for i in range(17)]
    rows += [(5, "Again", "s1"), (5, "Again", "s1"), (5, "Once more", "s1"), (None, "No id", "s1"), (None, None, None)]
    rows += [(9000, "A" * 200_000, "é"), (9001, "", "")]
    found = check(documents(rows).withColumn("no", F.lit(1)).withColumn("h0", F.lit("x")).withColumn("path", F.lit(1)).repartition(5))
    assert 0 < sum(not f[-1] for f in found) < len(found)


def test_one_row_and_none(documents):
    assert check(documents([(3, "Only", "s")]))[0][4] == digest()
    assert check(documents([(3, "One", "s"), (4, "Two", "t")]))
    assert check(documents([])) == []


def test_a_hot_group_is_many_ranges(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 3 = 0, id % 7, 0) as _group", "string(id) as h")
    ordered = merkle.in_order(rows, ["_group", "id", "h"])
    parts = ordered.where("_group = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    groups, placed = merkle.numbered(ordered, "_group")
    of = {}
    for r in sorted(rows.collect(), key=lambda r: (r._group, r.id)):
        of.setdefault(r._group, []).append(r.id)
    assert {(r._group, r.no, r.n) for r in groups.collect()} == {(g, k, len(of[g])) for k, g in enumerate(sorted(of))}
    assert {(r.id, r.pos) for r in placed.collect()} == {(i, k) for ids in of.values() for k, i in enumerate(ids)}
