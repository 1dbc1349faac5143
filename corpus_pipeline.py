"""Five stages from raw documents to packed training sequences.

Each stage takes the documents that the one before it kept, and each writes Parquet that the next one
reads. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdspan.llm import jaccard, linededup, mixing, packing, toxicity
from holdspan.llm.common import cut, table, unused
from holdspan.llm.queries import MIX_WEIGHTS

TOXIC = 0.7  # documents scored so high go
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SEQUENCE_TOKENS = 2048


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; learned from the labels of ``docs``' own rows.

    A score belongs to a row by its id and text, so rows repeated under one id are judged each.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, TOXIC)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that five or more documents share; every document stays.

    Rows without an id lose nothing; a null text stays null. Extra columns may have any name.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    changed = F.col("_n_dropped") > 0
    text = F.when(changed, F.col("_kept")).otherwise(F.col("row.text"))
    chars = F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text.alias("text"), "n_chars": chars.alias("n_chars")}
    return linededup.dedup_lines(rows).select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words or without an id are in no group and stay. Of rows that repeat an id, all
    stay if it is the smallest of its group. Extra columns may have any name.
    """
    classes = jaccard.similarity_classes(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    of = unused(docs, "_gone")
    gone = classes.where("doc_id > component_id").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(of), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture.

    No document goes: the weights decide which ones come first and stand together in sequences. Null
    and unnamed sources share a weight; repeated rows are all kept.
    """
    return mixing.mix_sources(docs, MIX_WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences, numbered as the mixture has them.

    Files are not read back in the order in which they were written, so documents are dealt out by the
    slots of the same schedule again. Null texts are their end id alone; repeated rows are packed each.
    """
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source"), MIX_WEIGHTS)
    return packing.pack(mixed, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE_TOKENS, end_id=1)


STAGES = [
    ("toxicity", keep_ordinary),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", one_of_each_class),
    ("mixing_sources", mix),
    ("packing", pack),
]

# Models, sketches and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    cut(spark.range(0))  # makes sure of a checkpoint folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
