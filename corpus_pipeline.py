"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import shared_dir, table
from leafmill.llm.decontaminate import without_passages
from leafmill.llm.near_copies import one_of_each
from leafmill.llm.packing import packed
from leafmill.llm.suffix_repeats import cleaned
from leafmill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores as toxic go.

    Every row is judged by its own text, a null one as an empty text; rows that
    repeat share their fate; without labels, and of an empty table, nothing goes.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 and more stays, that of the smallest doc_id.

    Null texts and texts without words are one group; rows that repeat doc_id
    and text are one document, different texts under one doc_id are compared
    like any others; rows without a doc_id stay.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier in the corpus are cut out of texts; every row stays.

    Null texts and rows without a doc_id stay as they are; rows that repeat are
    cut alike; n_chars follows the text.
    """
    return cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a near copy of a benchmark item go.

    Every row is judged by its own text; null and empty texts hold nothing and
    stay; without benchmark items nothing goes.
    """
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences, a row for each piece.

    A null text is empty: its one piece is the end id; rows that repeat and rows
    without a doc_id are documents of their own; an empty table gives no rows.
    """
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the stages (components of near copies, a learnt grammar, BPE packing); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between two stages stands a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/leafmill-stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
