"""What the operators share: tables, cut lineage, words."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the ASCII white space characters.
WHITE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that its branches start from one result.

    The folder is the one the session names; only a local session without any gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


ROWS_A_TASK = 50_000


def cut_small(df: DataFrame) -> DataFrame:
    """``cut``, and then as many tasks as there are ``ROWS_A_TASK`` rows, if those are fewer.

    For narrow rows that are read several times: the driver hears of each task of each reader.
    """
    done = cut(df)
    return done.coalesce(done.count() // ROWS_A_TASK + 1)


_HELD: dict = {}


def held(name: Hashable, make: Callable):
    """The one object that this Python worker keeps beyond a task, a cache or a model.

    Workers outlive operators; asking for another one lets go of the last, so caches do not add up.
    """
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


TEXTS_AT_ONCE = 1_000


def texts(docs: DataFrame) -> DataFrame:
    """``docs``, whose rows are handed to Python in batches for long texts, some MB each.

    The setting belongs to the session; one that is smaller already is kept.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= TEXTS_AT_ONCE:
        conf.set(name, TEXTS_AT_ONCE)
    return docs


def ascii_lower(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def sql_ascii_lower(c):
    """The same as a column."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
