"""URL rules in a sorted array of 64-bit digests that workers map into memory."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdspan.llm.common import ascii_lower

SLICE = 4_096  # urls probed at once


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return ascii_lower(host), tail[:stop]


def write_rules(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
    """The rules (host, path, verdict) as one file; its name.

    Layout: a line of JSON, then sorted digests, ends of the strings, verdicts and the strings. Rules
    of equal digest stand side by side and are told apart by their strings. A repeated rule keeps its
    last verdict.
    """
    last = {(ascii_lower(host), path): verdict for host, path, verdict in rules}
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\n{p}"), h, p, v) for (h, p), v in last.items())
    strings = [f"{h}\n{p}".encode() for _, h, p, _ in rows]
    head = {
        "n": len(rows),
        "bytes": sum(map(len, strings)),
        "paths": sorted({len(p) for _, _, p, _ in rows}),  # prefix lengths that can match
        "labels": sorted({h.count(".") + 1 for _, h, _, _ in rows}),  # host suffixes that can match
    }
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    name = os.path.join(folder, "rules.bin")
    with open(name, "wb") as out:
        out.write(line)
        out.write(np.array([d for d, *_ in rows], "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, strings)]).astype("<i8").tobytes())
        out.write(np.array([v == "block" for *_, v in rows], np.uint8).tobytes())
        out.write(b"".join(strings))
    return name


class RuleFile:
    """The file mapped into memory; processes of a machine share its pages."""

    def __init__(self, name: str):
        raw = np.memmap(name, np.uint8, "r")
        start = int(np.flatnonzero(raw[: 1 << 20] == 10)[0]) + 1
        self.head = json.loads(raw[:start].tobytes())
        n = self.head["n"]
        self.digests = raw[start : start + 8 * n].view("<u8")
        self.ends = raw[start + 8 * n : start + 16 * n + 8].view("<i8")
        self.block = raw[start + 16 * n + 8 : start + 17 * n + 8]
        self.strings = raw[start + 17 * n + 8 :]

    def string(self, at: int) -> str:
        return self.strings[self.ends[at] : self.ends[at + 1]].tobytes().decode()

    def match(self, split: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """For each (host, path) the longest fitting rule and whether it blocks."""
        owner, keys = [], []
        for i, (host, path) in enumerate(split):
            labels = host.split(".")
            for k in self.head["labels"]:
                if k > len(labels):
                    break
                suffix = ".".join(labels[-k:])
                for n in self.head["paths"]:
                    if n > len(path):
                        break
                    owner.append(i)
                    keys.append(f"{suffix}\n{path[:n]}")
        best: list[tuple[str, bool] | None] = [None] * len(split)
        if not keys or not self.head["n"]:
            return best
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        first = np.searchsorted(self.digests, wanted, "left")
        after = np.searchsorted(self.digests, wanted, "right")
        for j in np.flatnonzero(after > first):
            i, key = owner[j], keys[j]
            for at in range(first[j], after[j]):
                # A digest may stand for another string; only the stored one decides.
                if self.string(at) == key and (best[i] is None or len(key) - 1 > len(best[i][0])):
                    best[i] = (key.replace("\n", "", 1), bool(self.block[at]))
        return best


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Verdict of the longest rule that fits each url; ``default`` where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's; of two equally long
    ones the first found by fewer host labels holds. The rule file goes to every executor as a file of
    the application and is mapped there, so it needs no heap; nothing is shuffled. A null or malformed
    url has an empty host and path and no rule. Repeated rows are judged each; extra columns, ``html``
    among them, are not read.
    """
    context = pages.sparkSession.sparkContext
    # A new folder has a new name, so that rule files of several calls do not clash.
    folder = tempfile.mkdtemp(prefix="rules-")
    shared = os.path.join(folder, os.path.basename(folder) + ".bin")
    os.rename(write_rules(rules, folder), shared)
    context.addFile(shared)
    name = os.path.basename(shared)

    def judge(batches: Iterator[pa.RecordBatch]):
        table = RuleFile(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                split = [split_url(u) for u in part.column(1).to_pylist()]
                found = table.match(split)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([h for h, _ in split], pa.string()),
                        pa.array([p for _, p in split], pa.string()),
                        pa.array([f and f[0] for f in found], pa.string()),
                        pa.array([default if f is None else "block" if f[1] else "allow" for f in found], pa.string()),
                    ],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    return narrow.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
